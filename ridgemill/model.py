"""Shared definitions: table layouts, status codes, run descriptions.

Matrices are long tables. A feature matrix is (row_idx, feature, value), a
response matrix (row_idx, sample, value); row_idx runs from 0 and gives the rows
their order, which permutations index. Sparse tables leave rows of value 0 out.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from enum import IntEnum

RESULT = "feature string, sample string, beta double, se double, zscore double, pvalue double"

#: Standard errors up to this give a z-score of 0; spreads up to this a scaled value of 0.
SE_FLOOR = 1e-12
SD_FLOOR = 1e-10


class Status(IntEnum):
    """Outcome codes of a run."""

    OK = 0
    BAD_DIMENSIONS = -11
    NEGATIVE_LAMBDA = -12
    NULL_INPUT = -13
    NO_PERMUTATIONS = -14
    MEMORY = -100
    NOT_POSITIVE_DEFINITE = 10
    SOLVE_FAILED = 11


MESSAGES = {
    Status.OK: "success",
    Status.BAD_DIMENSIONS: "dimensions must be positive",
    Status.NEGATIVE_LAMBDA: "lambda must not be negative",
    Status.NULL_INPUT: "an input is missing",
    Status.NO_PERMUTATIONS: "the number of permutations must be positive",
    Status.MEMORY: "the projection does not fit the memory budget",
    Status.NOT_POSITIVE_DEFINITE: "the regularised Gram matrix is not positive definite",
    Status.SOLVE_FAILED: "solving for the projection failed",
}


class RidgeError(RuntimeError):
    """A run that ended with a status other than OK."""

    def __init__(self, status: Status) -> None:
        super().__init__(f"{MESSAGES[status]} (status {int(status)})")
        self.status = status


@dataclass
class RidgeRun:
    """What a low-level run returns beside its table."""

    result: object
    status: Status
    n_rows: int
    n_features: int
    lam: float
    n_rand: int
    sparse: bool = False
    warnings: list[str] = field(default_factory=list)
    watch: object = None

    @property
    def message(self) -> str:
        return MESSAGES[self.status]

    def check(self) -> int:
        """How many variances were negative beyond rounding, with a warning if any; to
        be called when the result has been made."""
        found = self.watch.get["negative_variances"] if self.result is not None else 0
        if found:
            self.warnings.append(f"{found} variances were negative and count as 0")
            warnings.warn(self.warnings[-1], stacklevel=2)
        return found

    def describe(self) -> str:
        """A text header of the run."""
        return "\n".join([f"ridge run: {self.message}", f"  rows x features: {self.n_rows} x {self.n_features}", f"  lambda: {self.lam:g}", f"  permutations: {self.n_rand}", f"  response: {'sparse' if self.sparse else 'dense'}"])
