"""Registered queries over the warehouse tables, each with the SQL that says the same."""
