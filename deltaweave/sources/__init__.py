"""Where relations come from and go to: changelogs with commits, tables, CNF and proof text."""

from .changelog import Engine, Input, Output
from .cnf import parse_cnf, read_cnf
from .tables import scratch, table

__all__ = ["Engine", "Input", "Output", "parse_cnf", "read_cnf", "scratch", "table"]
