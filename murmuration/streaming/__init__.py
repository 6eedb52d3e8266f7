"""Online filtering over a stream of observations."""
