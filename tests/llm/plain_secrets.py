"""Secret scans in plain Python, one symbol at a time, for tests."""

import math
import re

from skein.llm.secrets import CANDIDATES, DISCOVERY, ENCODINGS, LEAST_TOKEN

KINDS = ("assign", "access", "hex", "random")
#: The patterns as the job words them.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def tail(z):
    """P(Z > z) of a standard normal."""
    return math.erfc(z / math.sqrt(2)) / 2


def chi_tail(x, degrees):
    k = 2 / (9 * degrees)
    return tail(((max(x, 0) / degrees) ** (1 / 3) - (1 - k)) / math.sqrt(k))


def runs_tail(sides, none):
    n, above = len(sides), sum(sides)
    if above in (0, n):
        return none
    expected = 2 * above * (n - above) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    runs = 1 + sum(a != b for a, b in zip(sides, sides[1:], strict=False))
    return 1.0 if spread <= 0 else min(1, 2 * tail(abs(runs - expected) / math.sqrt(spread)))


def kind_of(sign):
    return "digit" if sign.isdigit() else "small" if sign.islower() else "other"


def p_value(token):
    """The battery's p-value of a token, null if it has no encoding."""
    bare = token.rstrip("=")
    alphabet = next((a for pattern, a in ENCODINGS if re.match(pattern, bare)), None)
    if alphabet is None or len(bare) < 2:
        return None
    x, m, n = [alphabet.index(c) for c in bare], len(alphabet), len(bare)
    mean = sum(x) / n
    kinds = {kind_of(c) for c in alphabet}
    share = {k: n * sum(kind_of(c) == k for c in alphabet) / m for k in kinds}
    between = sum((sum(kind_of(c) == k for c in bare) - e) ** 2 / e for k, e in share.items())
    whole = sum((x.count(k) - n / m) ** 2 / (n / m) for k in range(m))
    variance = sum((v - mean) ** 2 for v in x)
    covariance = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False))
    one_side = 2.0 ** (1 - n)
    serial = one_side if variance < 1e-9 else min(1, 2 * tail(abs(covariance / variance + 1 / n) * math.sqrt(n)))
    tests = [chi_tail(between, len(kinds) - 1), chi_tail(whole - between, m - len(kinds)), runs_tail([2 * v >= m for v in x], one_side), runs_tail([c in "aeiouAEIOU" for c in bare], 1.0), serial]
    h = -sum(math.log(max(p, 1e-300)) for p in tests)
    return math.exp(-h) * sum(h**k / math.factorial(k) for k in range(len(tests)))


def brute_force(text):
    """Spans (start, end, kind) of the patterns, and of the battery, for one text."""
    base = []
    for kind, pattern, ok in (("assign", re.compile(ASSIGN, re.ASCII), lambda m: len(m[2]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)):
        base += [(*m.span(), kind) for m in pattern.finditer(text) if ok(m)]
    tokens = [(p * len(m[0].rstrip("=")) / LEAST_TOKEN, *m.span()) for pattern in CANDIDATES for m in re.finditer(pattern, text) if (p := p_value(m[0])) is not None]
    tokens.sort()
    rejected = max((k for k in range(1, len(tokens) + 1) if tokens[k - 1][0] <= DISCOVERY * k / len(tokens)), default=0)
    return base, [(a, b, "random") for _, a, b in tokens[rejected:] if not any(s < b and a < e for s, e, _ in base)]


def brute_report(text):
    """The joined spans of the patterns, and of all kinds, for one text."""
    base, added = brute_force(text)
    order = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))
    return order(base), order([*base, *added])
