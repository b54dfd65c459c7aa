"""Boosted trees that decide which proposed spans are personal data.

No table has labelled spans, so the trees are fitted on synthetic spans that this module generates from
a fixed seed: SAMPLE of them per kind, a bound that no input changes. Fitting takes about a second on
the driver, once per process; executors get the trees as nested CASE expressions.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np

#: Kinds that the generators propose, in the order in which their spans are listed after the base kinds.
KINDS = ("email_alt", "phone_alt", "ssn", "iban", "hwaddr", "secret")
#: Synthetic spans of each kind for fitting, and as many again for calibration.
SAMPLE = 240
ROUNDS, DEPTH, RATE, PRECISION = 16, 3, 0.4, 0.98
#: Context words, looked for in the lower-cased characters before a span.
HINTS = {
    "h_phone": "tel|phone|call|fax|mobile|cell",
    "h_ssn": "ssn|social|security|sozial",
    "h_bank": "iban|account|konto|cuenta|compte|bank",
    "h_host": "mac|addr|host|ether|ipv6|device",
    "h_secret": "token|secret|key|passw|pwd|api|auth|bearer",
    "h_mail": "mail|contact|write|reach",
}
FEATURES = ("kind", "len", "digits", "upper", "lower", "distinct", "marks", "l_word", "r_word", *HINTS)


def features(kind: int, m: str, left: str, right: str) -> list[int]:
    """The same features that pii.py computes as Spark expressions."""
    word = lambda c: int(bool(re.match("[A-Za-z0-9_]", c)))
    low = left.lower()
    return [
        kind, len(m), len(re.findall("[0-9]", m)), len(re.findall("[A-Z]", m)), len(re.findall("[a-z]", m)), len(set(m)), len(re.findall("[^A-Za-z0-9 ]", m)),
        word(left[-1:]), word(right[:1]), *[int(bool(re.search(h, low))) for h in HINTS.values()],
    ]


def _examples(rng: random.Random, n: int) -> list[tuple[list[int], int]]:
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    pick = lambda s, k: "".join(rng.choice(s) for _ in range(k))
    word = lambda: pick("abcdefghilmnoprstuv", rng.randint(2, 9))
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hint = dict(zip(KINDS, (["mail me: ", "contact "], ["tel. ", "phone: ", "call "], ["ssn ", "social security "], ["iban ", "account "], ["mac ", "device addr "], ["token = \"", "api_key: ", "password="]), strict=True))
    year = lambda: str(rng.randint(1900, 2099))

    def positive(kind: str) -> str:
        if kind == "email_alt":
            return word() + rng.choice([" (at) ", "(at)", "[at]", " [at] "]) + word() + rng.choice([".", "(dot)", " [dot] "]) + rng.choice(["com", "org", "de"])
        if kind == "phone_alt":
            return rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(2)} {digits(3)} {digits(4)}"])
        if kind == "ssn":
            return f"{digits(3)}-{digits(2)}-{digits(4)}"
        if kind == "iban":
            return rng.choice(["DE", "FR", "ES", "GB"]) + digits(2) + rng.choice(["", " "]).join(["", *[digits(4) for _ in range(rng.randint(3, 5))]]) + digits(2)
        if kind == "hwaddr":
            return ":".join(pick(hexa, 2) for _ in range(6)) if rng.random() < 0.6 else ":".join(pick(hexa, 4) for _ in range(8))
        return rng.choice([pick(hexa, rng.choice([32, 40, 64])), pick(hexa, 40).upper(), pick(b64, rng.randint(24, 60)), "AKIA" + pick(b64[:26] + "0123456789", 16)])

    def negative(kind: str) -> str:
        if kind == "email_alt":
            return word() + " (at) " + word()
        if kind == "phone_alt":
            return rng.choice([f"{digits(2)} {digits(3)} {digits(3)}", f"{year()}.{digits(3)}.{digits(3)}", f"{year()}-{digits(3)}-{digits(3)}", f"{digits(4)} {digits(4)} {digits(4)}"])
        if kind == "ssn":
            return f"{digits(3)}-{digits(2)}-{digits(4)}"
        if kind == "iban":
            return pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2) + digits(2) + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", rng.choice([8, 12]))
        if kind == "hwaddr":
            return f"{digits(2)}:{digits(2)}:{digits(2)}"
        return rng.choice([digits(rng.randint(16, 30)), "-".join(word() for _ in range(4)) + digits(1), "/".join(word() for _ in range(4)) + digits(2), "_".join([word(), word(), year(), word()])])

    out = []
    for k, kind in enumerate(KINDS):
        for i in range(n):
            good = i % 2 == 0
            m = positive(kind) if good else negative(kind)
            # a bare nine-digit group in running text is no number of a person: only its context tells
            lead = rng.choice(hint[kind]) if good and (kind == "ssn" or rng.random() < 0.6) else word() + " "
            left, right = lead, rng.choice([" ", ".", ",", '"'])
            if not good and rng.random() < 0.3:
                left, right = rng.choice([(lead + pick("xyz0", 2), right), (lead, pick("xyz0", 2)), (rng.choice(["part no. ", "fig. "]), right)])
            out.append((features(k, m, left[-24:], right[:8]), int(good)))
    return out


def _tree(x: np.ndarray, r: np.ndarray, h: np.ndarray, depth: int):
    leaf = float(r.sum() / (h.sum() + 1.0))
    if not depth or len(r) < 12:
        return leaf
    best = (1e-6, None, None)
    whole = r.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[1:]:
            a = x[:, f] < cut
            ra, ha = r[a].sum(), h[a].sum()
            gain = ra**2 / (ha + 1) + (r.sum() - ra) ** 2 / (h.sum() - ha + 1) - whole
            if gain > best[0]:
                best = (gain, f, int(cut))
    if best[1] is None:
        return leaf
    a = x[:, best[1]] < best[2]
    return best[1], best[2], _tree(x[a], r[a], h[a], depth - 1), _tree(x[~a], r[~a], h[~a], depth - 1)


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


def margin(trees, row) -> float:
    return sum(_value(t, row) for t in trees)


@functools.cache
def fitted(seed: int = 20) -> tuple[tuple, tuple[float, ...]]:
    """(trees, a threshold on their sum for each kind). The thresholds reach PRECISION on spans not fitted on."""
    rng = random.Random(seed)
    train, held = _examples(rng, SAMPLE), _examples(rng, SAMPLE)
    x, y = np.array([f for f, _ in train]), np.array([g for _, g in train], float)
    s, trees = np.zeros(len(y)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-s))
        t = _tree(x, y - p, p * (1 - p), DEPTH)
        t = _scaled(t)
        trees.append(t)
        s += np.array([_value(t, row) for row in x])
    cuts = []
    for k in range(len(KINDS)):
        mine = sorted(((margin(trees, f), g) for f, g in held if f[0] == k), reverse=True)
        good, cut = 0, 0.0
        for i, (m, g) in enumerate(mine, 1):
            good += g
            if good >= PRECISION * i and (i == len(mine) or mine[i][0] < m):
                cut = (m + mine[i][0]) / 2 if i < len(mine) else m
        cuts.append(round(cut, 6))
    return tuple(trees), tuple(cuts)


def _scaled(t):
    return (t[0], t[1], _scaled(t[2]), _scaled(t[3])) if isinstance(t, tuple) else round(RATE * t, 6)
