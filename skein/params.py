"""Parameters of a computation, their validation, and the errors that users see."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace


class RipsError(ValueError):
    """Any error of this package that is the caller's to mend."""


class InvalidDistance(RipsError):
    def __init__(self, what: str):
        super().__init__(f"invalid distance: {what}")


class InvalidInput(RipsError):
    def __init__(self, what: str):
        super().__init__(f"invalid input: {what}")


class IndexOverflow(RipsError):
    def __init__(self, n: int, dim: int):
        super().__init__(f"simplex index space overflows u64 for {n} points in dimension {dim}")
        self.n, self.dim = n, dim


class InputOutput(RipsError):
    def __init__(self, what: str):
        super().__init__(f"io error: {what}")


#: Primes must be below MODULUS_END; indices are unsigned 64-bit, and ours are also below 2 ** 63.
MODULUS_END = 1 << 15
INDEX_BITS, OWN_BITS = 64, 63


@dataclass(frozen=True)
class RipsParams:
    """max_dim: highest homology dimension. threshold: largest diameter, None for the space's default. modulus: the
    prime of the coefficients. threads: a hint at parallelism that never changes a result. The toggles never change
    a result either."""

    max_dim: int = 1
    threshold: float | None = None
    modulus: int = 2
    threads: int = 1
    use_emergent_pairs: bool = True
    use_apparent_pairs: bool = True
    use_clearing: bool = True

    def with_threshold(self, threshold: float) -> RipsParams:
        return replace(self, threshold=threshold)

    def with_modulus(self, modulus: int) -> RipsParams:
        return replace(self, modulus=modulus)

    def with_threads(self, threads: int) -> RipsParams:
        return replace(self, threads=threads)

    def validate(self) -> RipsParams:
        """Checks what doesn't depend on the space; an empty space is checked too."""
        if self.threshold is not None and not self.threshold >= 0:
            raise InvalidInput(f"threshold must be non-negative, got {rust_float(self.threshold)}")
        if not is_prime(self.modulus) or self.modulus >= MODULUS_END:
            raise InvalidInput(f"modulus must be a prime below {MODULUS_END}, got {self.modulus}")
        if self.max_dim < 0 or self.threads < 0:
            raise InvalidInput("max_dim and threads must not be negative")
        return self


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, math.isqrt(n) + 1))


def coefficient_bits(modulus: int) -> int:
    """Bits that a packed coefficient takes from a 64-bit index; none over Z/2."""
    return 0 if modulus == 2 else (modulus - 1).bit_length()


def checked_dim(n: int, max_dim: int, modulus: int = 2) -> int:
    """max_dim, at most n - 1, for a space of n points whose simplices can be indexed."""
    dim = min(max_dim, max(n - 1, 0))
    top = dim + 2
    # C(n, j) grows up to j = n // 2: the largest of the table's entries decides.
    if n and math.comb(n, min(top, n // 2)) >= 1 << INDEX_BITS or math.comb(n, min(top, n)) > (1 << INDEX_BITS - coefficient_bits(modulus)) - 1:
        raise IndexOverflow(n, dim)
    if math.comb(n, min(top, n)) >= 1 << OWN_BITS:
        raise IndexOverflow(n, dim)
    return dim


def rust_float(x: float) -> str:
    """Shortest digits that read back as the same double, never with an exponent; 1 for 1.0, inf, NaN."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    from decimal import Decimal

    text = format(Decimal(repr(x)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text
