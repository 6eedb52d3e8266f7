"""Densities of Columns, numpy arrays or numbers."""

from __future__ import annotations

import math

from .elementwise import exp, log

ROOT_2PI = math.sqrt(2 * math.pi)


def normal_pdf(x, mean, sd):
    z = (x - mean) / sd
    return exp(-0.5 * z * z) / (ROOT_2PI * sd)


def log_normal_pdf(x, mean, sd):
    z = (x - mean) / sd
    return -0.5 * z * z - log(ROOT_2PI * sd)
