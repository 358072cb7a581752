"""A character convolutional network in numpy that tells secrets from other long tokens.

The input is a candidate in the middle of its surroundings: WINDOW characters, each as a class (letters and marks of
their own, digits as one) with a flag for whether it lies in the candidate. A candidate too long for one window has
several that overlap, from MARGIN characters before it to MARGIN after it, and the highest counts. An embedding, a
convolution of width KERNEL with ReLU, the maximum and the mean over positions, and a linear layer give a logit.

It is trained when it is first needed, on labelled findings that `labelled` makes from a fixed seed: tokens of the forms
that issuers use, and harmless tokens of the same length (words, names, addresses, paths, numbers, identifiers), each
in prose. As many are long runs: harmless tokens joined, in one half with a secret among them or at the end, and each of
their windows is learned by how much of the secret it holds. One part is held back: on it the logits of candidates are
calibrated (a scale and a shift by logistic regression), and the threshold is the highest one that still finds RECALL of
the secrets there, among the short ones, among the long ones, and among those of `findings`, which are written by hand."""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

import numpy as np

from tessera.llm import findings

WINDOW = 64
#: A candidate of more characters than FIT is seen through windows STEP apart, so a secret of up to WINDOW - STEP + 1 characters lies in one whole.
MARGIN = 8
FIT, STEP = WINDOW * 3 // 4, 16
KERNEL = 5
EMBED, FILTERS = 8, 32
RECALL = 0.99
EXAMPLES, STEPS, BATCH, SEED = 4000, 600, 96, 20

#: Windows that are scored at once; bounds memory however long a candidate is.
AT_ONCE = 2048

MARKS = "+/_=-.:\"'@ \n,;()"
#: Zeros stand beyond the text; all digits are one class, letters and marks have their own, and the last three are other ASCII, other letters and all else.
LETTERS, OTHER = 2, 2 + 2 * 26 + len(MARKS)
N_CLASSES = OTHER + 3


def _class(c: str) -> int:
    if not c.isascii():
        return OTHER + 1 if c.isalpha() else OTHER + 2
    if c.isdigit():
        return 1
    if c.isalpha():
        return LETTERS + (ord(c) - ord("a") if c.islower() else 26 + ord(c) - ord("A"))
    return LETTERS + 52 + MARKS.index(c) if c in MARKS else OTHER


TABLE = np.array([_class(chr(c)) for c in range(128)], np.int64)


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = TABLE[np.minimum(points, 127)]
    for k in np.flatnonzero(points > 127):
        out[k] = _class(text[k])
    return out


def _starts(start: int, end: int) -> np.ndarray:
    """Where the windows of a candidate begin."""
    if end - start <= FIT:
        return np.array([start - (WINDOW - (end - start)) // 2])
    last = end + MARGIN - WINDOW
    return np.array([*range(start - MARGIN, last, STEP), last])


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Rows of classes of WINDOW characters around and along text[start:end], plus N_CLASSES inside it; 0 beyond the text."""
    at = _starts(start, end)
    first, stop = int(at[0]), int(at[-1]) + WINDOW
    codes = np.zeros(stop - first, np.uint8)
    low, high = max(first, 0), min(stop, len(text))
    codes[low - first : high - first] = _codes(text[low:high])
    codes[start - first : end - first] += N_CLASSES
    return np.lib.stride_tricks.sliding_window_view(codes, WINDOW)[at - first]


# --- labelled findings --------------------------------------------------------------------------------------------

WORDS = "the of and to in is on by for with this that from are was not which have has der die und ist ein nicht les des une que para los con como".split()


def _token(r: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(r.choice(letters) for _ in range(r.randint(low, high)))


def _word(r: random.Random, low: int = 2, high: int = 6) -> str:
    return "".join(r.choice(("re", "th", "on", "er", "ing", "au", "ent", "la", "mi", "st", "che", "do", "ver", "pa", "qu", "is", "ö", "é")) for _ in range(r.randint(low, high)))


def _spelled(r: random.Random, low: int, high: int) -> str:
    """A word of syllables."""
    return "".join(r.choice("bcdfghklmnprstvwz") * (r.random() < 0.9) + r.choice(("a", "e", "i", "o", "u", "ei", "ou", "ie")) + r.choice(("", "", "n", "r", "s", "l", "t", "ng", "st", "ch")) for _ in range(r.randint(low, high)))


def _secret(r: random.Random) -> str:
    alnum, upper = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    return r.choice(
        (
            lambda: "AKIA" + _token(r, upper, 16, 16),
            lambda: _token(r, "0123456789abcdef", 24, 64),
            lambda: _token(r, alnum, 20, 48),
            lambda: _token(r, alnum + "+/", 28, 60) + r.choice(("", "=", "==")),
            lambda: r.choice(("ghp_", "sk_live_", "xoxb-", "glpat-", "npm_")) + _token(r, alnum, 20, 40),
            lambda: "eyJ" + _token(r, alnum + "_-", 30, 60),
            lambda: _token(r, string.ascii_letters, 24, 44),
            lambda: _token(r, "0123456789ABCDEF", 24, 48),
            lambda: _token(r, string.ascii_uppercase + "234567", 24, 40),
            lambda: _token(r, string.ascii_lowercase + string.digits, 24, 40),
            lambda: r.choice("-_/").join(_token(r, r.choice((alnum, upper)), 4, 8) for _ in range(r.randint(4, 6))),
            lambda: "".join(_token(r, "0123456789ABCDEF", 4, 8) * 3 for _ in range(r.randint(2, 3))),
        )
    )()


def _harmless(r: random.Random) -> str:
    return r.choice(
        (
            lambda: _word(r, 7, 12),
            lambda: "-".join(_word(r, 1, 3) for _ in range(r.randint(3, 6))) + r.choice(("", "-2", "-2024")),
            lambda: "/".join(_word(r, 1, 3) for _ in range(r.randint(3, 6))) + r.choice(("", "/v1", "/2")),
            lambda: "_".join(_word(r, 1, 3) for _ in range(r.randint(3, 6))) + r.choice(("", "_1", "_x2")),
            lambda: "".join(_word(r, 1, 2).capitalize() for _ in range(r.randint(4, 7))) + r.choice(("", "1", "2D")),
            lambda: _token(r, string.digits, 8, 16) + "-" + _token(r, string.digits, 8, 16),
            lambda: _word(r, 2, 3) + str(r.randint(1, 99)) + "_" + _word(r, 4, 6),
            lambda: "=" * r.randint(8, 20) + str(r.randint(1, 9)) + "=" * r.randint(8, 20),
            lambda: "20%02d-%02d-%02d_%02d-%02d-%02d-" % tuple(r.randint(1, 12) for _ in range(6)) + _word(r, 2, 3),
            lambda: (_word(r, 1, 1) + str(r.randint(0, 9))) * r.randint(6, 9),
            lambda: _spelled(r, 6, 10),
            lambda: _spelled(r, 6, 10).capitalize(),
            lambda: _spelled(r, 6, 10).upper(),
            lambda: r.choice("-_/").join(_spelled(r, 1, 3) for _ in range(r.randint(4, 7))),
            lambda: "_".join(_spelled(r, 1, 3).upper() for _ in range(r.randint(3, 5))),
            lambda: _spelled(r, 1, 2) + "".join(_spelled(r, 1, 3).capitalize() for _ in range(r.randint(3, 5))),
            lambda: "/".join((_spelled(r, 1, 2), "20%02d" % r.randint(0, 30), "%02d" % r.randint(1, 12), "-".join(_spelled(r, 1, 2) for _ in range(3)))),
            lambda: "20%02d-%02d-%02d" % (r.randint(0, 30), r.randint(1, 12), r.randint(1, 31)) + r.choice("-_T") + r.choice((_spelled(r, 4, 6), "%02d-%02d-%02d" % (r.randint(0, 23), r.randint(0, 59), r.randint(0, 59)))),
            lambda: r.choice(string.ascii_letters + string.digits + "-_=+/") * r.randint(20, 50),
            lambda: _spelled(r, 1, 1) + r.choice(string.ascii_lowercase) * r.randint(18, 40) + _spelled(r, 0, 1),
            lambda: (string.ascii_lowercase * 2)[(k := r.randint(0, 25)) : k + r.randint(20, 26)] if r.random() < 0.5 else (string.ascii_uppercase + string.digits)[: r.randint(24, 36)],
            lambda: _token(r, string.digits, 20, 44),
            lambda: r.choice("-/_").join(_token(r, string.digits, 2, 7) for _ in range(r.randint(5, 8))),
        )
    )()


Finding = tuple[str, int, int, int, int]


def _in_prose(r: random.Random, token: str) -> tuple[str, int]:
    lead = r.choice(("", "key = ", "auth: ", 'id="', "ref ", "see ", "at ", "x=")) if r.random() < 0.4 else ""
    before = " ".join(r.choice((r.choice(WORDS), _word(r))) for _ in range(r.randint(0, 8)))
    after = " ".join(r.choice((r.choice(WORDS), _word(r))) for _ in range(r.randint(0, 8)))
    text = f"{before} {lead}"
    return text + token + r.choice((" ", ".", ", ", "\n", '" ')) + after, len(text)


def short_finding(r: random.Random) -> Finding:
    """A text with the start and end of a candidate, and of the secret in it (equal ones: none)."""
    good = r.random() < 0.5
    token = _secret(r) if good else _harmless(r)
    text, start = _in_prose(r, token)
    return text, start, start + len(token), start, start + len(token) * good


def long_finding(r: random.Random, good: bool | None = None, at_end: bool | None = None) -> Finding:
    """The same for a run of harmless tokens, where the secret is at the end or among them."""
    good = r.random() < 0.5 if good is None else good
    at_end = r.random() < 0.6 if at_end is None else at_end
    mark = r.choice("//-_=+")

    def part() -> str:  # non-ASCII letters would end a candidate
        return _harmless(r).translate(str.maketrans("öé", "oe"))

    head = r.choice(("", "/")) + part() + mark
    least = r.randint(FIT + MARGIN, 3 * WINDOW)
    while len(head) < least:
        head += part() + mark
    secret = _secret(r) if good else ""
    tail = "" if good and at_end else (mark if good else "") + part() + "".join(mark + part() for _ in range(r.randint(0, 3)))
    text, start = _in_prose(r, head + secret + tail)
    a = start + len(head)
    return text, start, a + len(secret) + len(tail), a, a + len(secret)


def labelled(n: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Of short findings, the first window of each and whether it is a secret."""
    r = random.Random(seed)
    own = [short_finding(r) for _ in range(n)]
    return np.array([windows(t, a, b)[0] for t, a, b, *_ in own]), np.array([float(d > c) for *_, c, d in own])


def parts(found: list[Finding]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of findings, with 1 where a window holds a secret (20 characters of it at least) and 0 where it holds nothing of one; others are left out."""
    x, y = [], []
    for text, a, b, c, d in found:
        w, at = windows(text, a, b), _starts(a, b)
        held = np.clip(np.minimum(at + WINDOW, d) - np.maximum(at, c), 0, None)
        clear = (held == 0) | (held >= min(20, max(d - c, 1)))
        x.append(w[clear])
        y.append((held > 0)[clear].astype(float))
    return np.concatenate(x), np.concatenate(y)


# --- the network --------------------------------------------------------------------------------------------------


@dataclass
class Net:
    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        e = w["embed"][x]
        cols = np.lib.stride_tricks.sliding_window_view(e, KERNEL, axis=1).reshape(len(x), WINDOW - KERNEL + 1, EMBED * KERNEL)
        z = cols @ w["conv"] + w["bias"]
        a = np.maximum(z, 0)
        top = a.argmax(1)
        pooled = np.concatenate([a.max(1), a.mean(1)], 1)
        return pooled @ w["out"] + w["const"], (cols, z, top, pooled)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability, by window, that a secret is there."""
        return self._calibrated(self.logits(x))

    def probability_of(self, rows: list[np.ndarray]) -> np.ndarray:
        """Calibrated probability that a candidate with these windows is or holds a secret."""
        return self._calibrated(self.highest(rows))

    def _calibrated(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -500, 500)))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.forward(x[k : k + AT_ONCE])[0] for k in range(0, len(x), AT_ONCE))])

    def highest(self, rows: list[np.ndarray]) -> np.ndarray:
        """The highest logit among the windows of each candidate."""
        if not rows:
            return np.zeros(0)
        return np.maximum.reduceat(self.logits(np.concatenate(rows)), np.cumsum([0, *map(len, rows[:-1])]))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, (logit, (cols, z, top, pooled)) = self.weights, self.forward(x)
        d = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y) / len(x)
        dp = d[:, None] * w["out"]
        da = np.repeat(dp[:, None, FILTERS:] / z.shape[1], z.shape[1], 1)
        da[np.arange(len(x))[:, None], top, np.arange(FILTERS)] += dp[:, :FILTERS]
        dz = da * (z > 0)
        dcols = (dz @ w["conv"].T).reshape(len(x), z.shape[1], EMBED, KERNEL)
        de = np.zeros((len(x), WINDOW, EMBED), np.float32)
        for k in range(KERNEL):
            de[:, k : k + z.shape[1]] += dcols[..., k]
        embed = np.stack([np.bincount(x.ravel(), de[..., k].ravel(), len(w["embed"])) for k in range(EMBED)], 1)
        flat = cols.reshape(-1, EMBED * KERNEL)
        return {"embed": embed, "conv": flat.T @ dz.reshape(-1, FILTERS), "bias": dz.sum((0, 1)), "out": pooled.T @ d, "const": d.sum()}


def train(n: int = EXAMPLES, steps: int = STEPS, seed: int = SEED) -> Net:
    r = random.Random(seed)
    short, long = [short_finding(r) for _ in range(n)], [long_finding(r) for _ in range(n)]
    rng = np.random.default_rng(seed)
    cut = n * 3 // 4
    sets = [parts(short[:cut]), parts(long[:cut])]
    net = Net(
        {
            "embed": rng.normal(0, 0.3, (2 * N_CLASSES, EMBED)).astype(np.float32),
            "conv": rng.normal(0, (2 / (EMBED * KERNEL)) ** 0.5, (EMBED * KERNEL, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32),
            "const": np.zeros((), np.float32),
        }
    )
    m, v = ({k: np.zeros_like(w) for k, w in net.weights.items()} for _ in range(2))
    for t in range(1, steps + 1):  # Adam
        picks = [(x[k], y[k]) for x, y in sets for k in [rng.integers(0, len(x), BATCH)]]  # as many of short and of long ones
        for name, g in net.gradient(*(np.concatenate(z) for z in zip(*picks, strict=True))).items():
            m[name] = 0.9 * m[name] + 0.1 * g
            v[name] = 0.999 * v[name] + 0.001 * g * g
            rate = 0.01 * min(1.0, 2 * (1 - t / (steps + 1)))
            net.weights[name] = (net.weights[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    back = short[cut:] + long[cut:]
    held = net.highest([windows(t, a, b) for t, a, b, *_ in back])
    truth = np.array([float(d > c) for *_, c, d in back])
    for _ in range(500):  # calibration
        p = 1 / (1 + np.exp(-np.clip(net.scale * held + net.shift, -500, 500)))
        net.scale -= 0.05 * float(((p - truth) * held).mean())
        net.shift -= 0.05 * float((p - truth).mean())
    p = net._calibrated(held)
    by_hand = net.probability_of([windows(*findings.finding(*f)) for f in findings.SECRETS])
    good = [np.sort(x) for x in (*(p[k][truth[k] == 1] for k in (slice(0, n - cut), slice(n - cut, None))), by_hand)]
    net.threshold = min(float(g[int((1 - RECALL) * len(g))]) for g in good)
    return net
