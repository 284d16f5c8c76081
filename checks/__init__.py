"""Queries over the test tables with independent SQL oracles."""

from checks import models, statistics, tables, workflow

REGISTERED = [tables, statistics, models, workflow]
