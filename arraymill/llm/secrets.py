"""Secret scans with a random forest against false positives.

Candidates are runs of letters, digits and + / _ - . that are long enough and
hold a digit, or are all capitals, or stand after = or :, and besides them the
whole value, quoted or up to a blank, that is put behind a name with one of
SECRET_WORDS, from NAMED_LEAST bytes on, and whole armoured blocks (as of
private keys, but of certificates too). Each is described by its length, its
characters and how they follow each other (against the pairs of characters of
the whole corpus), how much of it the corpus' frequent words cover, the path it
came from and the words around it. A random forest, trained from labelled
findings, tells secrets from identifiers, digests and the like.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bounded
from ._text import LOWER, flat, runs, separators, span_hashes, words

_U = np.uint64
LEAST, NAMED_LEAST, MAX_FINDINGS = 12, 4, 20_000
_JOINT = separators((0x00, 0x2A), (0x2C, 0x2C), (0x3A, 0x40), (0x5B, 0x5E), (0x60, 0x60), (0x7B, 0xFF))
_LETTERS = separators((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_DIGIT = separators((0x30, 0x39))
_UPPER = separators((0x41, 0x5A))
#: Words that stand by secrets, and words that stand by look-alikes.
SECRET_WORDS = frozenset("password passwd pwd pass secret token key apikey api auth bearer credential credentials private access login aws session".split())
PLAIN_WORDS = frozenset("commit sha sha1 sha256 sha512 md5 hash checksum digest etag uuid guid revision rev version build integrity file image url http https www tel phone isbn order id ref mail email at".split())
SHAM_WORDS = frozenset("example sample dummy placeholder changeme test fake your xxxx todo redacted".split())
PATH_HINTS = ("test", "example", "doc", "lock", "sample", "fixture")
_CONFIG = ("env", "conf", "secret", "cred", "yaml", "yml", "ini", "properties")
_AROUND = 48
WORD = re.compile(rb"[A-Za-z]+")
#: What is named before = or :, the words of a name, and the value after it.
_NAME = re.compile(rb"([A-Za-z0-9_.-]+)[\"'\]]{0,2}[ \t]*[:=]?\Z")
_PARTS = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_VALUE = re.compile(rb"[:=>]{0,2}[ \t]*(?:\"([^\"\r\n]+)\"|'([^'\r\n]+)'|([^\s\"']\S*))")
_CLOSED = re.compile(rb"[\"'][\"',;)\]}>]*\Z")
_PUTS = separators((0x3A, 0x3A), (0x3D, 0x3D))
_PUNCT = separators((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_BEGIN, _LINES = re.compile(rb"-----BEGIN ([A-Z0-9 ]{1,60})-----"), re.compile(rb"[A-Za-z0-9+/=\s]*")
_STARTS = re.compile(rb"AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abprs]-|AIza|eyJ|glpat-|npm_|pypi-|SG\.|rk_")


@dataclass
class Corpus:
    """Log-probabilities of byte pairs, and buckets of frequent words."""

    pairs: np.ndarray
    frequent: np.ndarray


def corpus_counts(docs: DataFrame, text_col: str = "text") -> Corpus:
    """Counts over all documents; what reaches the driver has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, seen = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for b in batches:
            data, offs = flat(b.column(0))
            for i, j in runs(offs):
                raw = data[offs[i] : offs[j]]
                pairs += np.bincount(raw[:-1].astype(np.int64) * 256 + raw[1:], minlength=1 << 16)
                low = LOWER[raw]
                s, e, _ = words(low, offs[i : j + 1] - offs[i], _LETTERS)
                seen += np.bincount((span_hashes(low, s, e)[e - s > 3] >> _U(48)).astype(np.int64), minlength=1 << 16)
        both = np.concatenate([pairs, seen])
        k = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(both[k])], ["k", "c"])

    got = np.zeros(1 << 17)
    for k, c in bounded(docs.select(text_col)).mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c")).toLocalIterator():
        got[k] = c
    pairs = got[: 1 << 16].reshape(256, 256)
    seen = got[1 << 16 :]
    return Corpus(np.log((pairs + 0.1) / (pairs.sum(1, keepdims=True) + 25.6)), seen > max(4.0, 8 * seen.mean()))


def _covered(text: bytes, corpus: Corpus) -> float:
    """The share of the characters in frequent words of four to twelve letters, the longest first, greedily from the left."""
    raw = LOWER[np.frombuffer(text, np.uint8)]
    s, e, _ = words(raw, np.array([0, len(raw)]), _LETTERS)
    long = e - s > 3
    s, e = s[long], e[long]
    if not len(s):
        return 0.0
    at = np.arange(int((e - s - 3).sum())) - np.repeat(np.cumsum(e - s - 3) - (e - s - 3) - s, e - s - 3)  # where four letters fit
    end = np.repeat(e, e - s - 3)
    most = np.zeros(len(raw) + 1, dtype=np.int64)
    for n in range(4, 13):
        on = at[at + n <= end]
        if len(on):
            known = on[corpus.frequent[(span_hashes(raw, on, on + n) >> _U(48)).astype(np.int64)]]
            most[known] = n
    steps, hit, i = most.tolist(), 0, 0
    while i < len(raw):
        hit += steps[i]
        i += steps[i] or 1
    return hit / len(text)


def _names_secret(before: bytes) -> bool:
    """Whether the text before a = or : ends in a name with one of SECRET_WORDS."""
    m = _NAME.search(before[-_AROUND:])
    if m is None:
        return False
    name = m[1].decode()
    return any(w.decode().lower() in SECRET_WORDS for w in (*_PARTS.findall(m[1]), *WORD.findall(m[1]))) or name.rstrip("0123456789").lower().endswith(("password", "passwd", "secret", "token", "apikey"))


def features(text: bytes, before: bytes, after: bytes, path: str, corpus: Corpus) -> list[float]:
    """What the forest sees of one candidate."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    digit, upper = _DIGIT[raw], _UPPER[raw]
    lower = _DIGIT[raw] == 0
    lower &= (raw >= 0x61) & (raw <= 0x7A)
    kind = digit + 2 * upper + 3 * lower
    freq = np.bincount(raw, minlength=1)
    p = freq[freq > 0] / n
    near = [w.decode().lower() for w in WORD.findall(before)[-3:]]
    later = [w.decode().lower() for w in WORD.findall(after)[:2]]
    quoted = before.rstrip()[-1:] in (b'"', b"'")
    tail = before.rstrip(b" \"'")
    inner = [w.decode().lower() for w in WORD.findall(text)]
    where = path.lower()
    return [
        n,
        digit.mean(),
        upper.mean(),
        lower.mean(),
        float(np.isin(LOWER[raw], np.frombuffer(b"0123456789abcdef", np.uint8)).all()),
        float(-(p * np.log2(p)).sum()),
        float((kind[1:] != kind[:-1]).mean()),
        float(corpus.pairs[raw[:-1], raw[1:]].mean()),
        float(np.minimum(corpus.pairs[raw[:-1], raw[1:]], -4).mean()),
        _covered(text, corpus),
        float(sum(b in b"._-/+" for b in text)) / n,
        float(bool(_STARTS.match(text))),
        float(np.diff(np.concatenate([[0], np.flatnonzero(raw[1:] != raw[:-1]) + 1, [n]])).max()) / n,  # the longest run of one character
        float(tail[-1:] in (b"=", b":")),
        float(quoted),
        float(any(w in SECRET_WORDS for w in near[-2:])),
        float(any(w in PLAIN_WORDS for w in near[-2:])),
        float(any(w in SHAM_WORDS for w in (*near, *later, *inner))),
        float(before[-1:] == b"@" or after[:1] == b"@" or b"://" in before[-12:]),
        float(any(h in where for h in PATH_HINTS)),
        float(any(h in where for h in _CONFIG)),
        float(any(w in SECRET_WORDS for w in later)),
        float(_PUNCT[raw].mean()),
        float(tail[-1:] in (b"=", b":") and _names_secret(tail[:-1])),
        float(before[-1:] in (b" ", b"\t")),
        float(any(x in text for x in (b"(", b"${", b"{{", b"<", b"["))),
        float(text.startswith(b"-----BEGIN ")) + float(b"PRIVATE KEY" in text[:60]),
    ]


class Forest:
    """Trees grown on samples of the rows, each cut the best of a random few features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 48, depth: int = 9, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows], depth, rng))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
        """Nodes as (feature, cut, left, right), leaves as their mean."""
        mean = float(y.mean())
        if depth == 0 or len(y) < 8 or mean in (0.0, 1.0):
            return (mean,)
        best: tuple = (np.inf,)
        for f in rng.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            at = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(at):
                continue
            left = np.cumsum(t)[at - 1]
            right = t.sum() - left
            impurity = left * (1 - left / at) + right * (1 - right / (len(t) - at))
            k = int(np.argmin(impurity))
            if impurity[k] < best[0]:
                best = (impurity[k], int(f), float(v[at[k] - 1] + v[at[k]]) / 2)
        if len(best) == 1:
            return (mean,)
        on = x[:, best[1]] <= best[2]
        if on.all() or not on.any():
            return (mean,)
        return (best[1], best[2], self._grow(x[on], y[on], depth - 1, rng), self._grow(x[~on], y[~on], depth - 1, rng))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))

        def walk(node: tuple, rows: np.ndarray) -> None:
            if len(node) == 1:
                out[rows] += node[0]
            elif len(rows):
                on = x[rows, node[0]] <= node[1]
                walk(node[2], rows[on])
                walk(node[3], rows[~on])

        for tree in self.trees:
            walk(tree, np.arange(len(x)))
        return out / len(self.trees)


def made_findings(n: int = 4000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (before, candidate, after, path, label) made by rule, for where no reviewed ones are at hand."""
    r = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa = lambda k: some("0123456789abcdef", k)
    syl = lambda: r.choice("ba co de fi go lu ma ne po ra si tu ver ing tion ent and the ous able con pre der sch mente que eau".split())
    word = lambda: "".join(syl() for _ in range(r.randint(1, 5)))
    text = lambda k: " ".join(word() for _ in range(k))
    marks = "!@#$%^&*~?"
    line = lambda k: some(low + up + dig + "+/", k)
    block = lambda name: "\n".join([f"-----BEGIN {name}-----", *(line(64) for _ in range(r.randint(2, 12))), line(r.randint(4, 60)) + "=", f"-----END {name}-----"])
    said_of = lambda: r.choice(["access", "login", "session", "auth", "key", "token", "secret", "password", "pass", "private", "api"])
    plain = ["src/app.py", "README.md", "src3", "notes.txt", "web/page.html", "main.go"]
    paths = [*plain, "config/prod.env", "settings.yaml", "deploy/secrets.yml"]
    out = []
    for i in range(n):
        name = r.choice(["password", "passwd", "secret", "token", "api_key", "apiKey", "auth_token", "access_key", "private_key", "client_secret"])
        put = r.choice(["=", " = ", ": ", ":", '="', ' = "', '": "'])
        lead, tail = text(r.randint(0, 4)), text(r.randint(0, 4))
        if i % 2:
            kind = r.randrange(14)
            value = [
                lambda: r.choice(["AKIA", "ASIA"]) + some(up + "234567" if r.random() < 0.5 else up + dig, 16),
                lambda: r.choice(["ghp_", "gho_", "ghs_"]) + some(low + up + dig, 36),
                lambda: r.choice(["sk-", "sk_live_", "rk_live_"]) + some(low + up + dig, r.randint(20, 48)),
                lambda: f"xoxb-{some(dig, 11)}-{some(low + up + dig, 24)}",
                lambda: "AIza" + some(low + up + dig + "_-", 35),
                lambda: "eyJ" + some(low + up + dig, 30) + "." + "eyJ" + some(low + up + dig, 40) + "." + some(low + up + dig + "_-", 43),
                lambda: hexa(r.choice([16, 18, 20, 24, 32, 40, 64])),
                lambda: some(low + up + dig + "+/", r.choice([20, 32, 40, 44])),
                lambda: some(low + up + dig, r.randint(12, 24)),
                lambda: some(low + up + dig, r.randint(6, 11)),
                lambda: r.choice([str, str.capitalize])(word()[: r.randint(4, 9)]) + some(dig, r.randint(1, 4)),
                lambda: r.choice([str, str.capitalize])(word()[:8]) + some(marks, 1) + r.choice([word()[:6], some(low + dig, 3)]) + some(marks, r.randint(0, 1)) + some(dig, r.randint(1, 4)),
                lambda: some(low + up + dig + marks, r.randint(8, 20)),
                lambda: block(r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK"])),
            ][kind]()
            bare = kind == 13 or (kind < 6 and r.random() < 0.6)
            before = f"{lead} " if bare else f"{lead} {name}{put}"
            out.append((before, value, ('" ' if put.endswith('"') and not bare else " ") + tail, r.choice(paths), 1))
            continue
        kind = r.randrange(19)
        said = r.choice(["commit", "sha256", "md5", "checksum", "digest", "integrity", "rev", "hash", "etag", "uuid", "id"])
        before, value = [
            lambda: (f"{lead} {said} ", hexa(r.choice([32, 40, 64]))),
            lambda: (f"{lead} {said}{r.choice([':', '=', ': '])}", hexa(r.choice([32, 40, 64]))),
            lambda: (f"{lead} ", f"{hexa(8)}-{hexa(4)}-4{hexa(3)}-a{hexa(3)}-{hexa(12)}"),
            lambda: (f"{lead} {word()}.{some(dig, 2)}@", f"mail{r.randint(1, 9)}.example.com"),
            lambda: (f"{lead} https://", f"www{r.randint(1, 9)}.{word()}.org/{word()}/{r.randint(1, 999)}"),
            lambda: (f"{lead} ", f"{word()}_{word()}_{r.randint(1, 99)}x"),
            lambda: (f"{lead} ", "".join(word().capitalize() for _ in range(3)) + str(r.randint(1, 9))),
            lambda: (f"{lead} ", "".join(word().upper() for _ in range(5))),
            lambda: (f"{lead} {name}{put}", r.choice(["changeme12345", "your-password-here1", "xxxxxxxxxxxxxxxx", "example-token-1234", "dummy_secret_value1", "test-test-test-123", "********1234567", "placeholder00001"])),
            lambda: (f"{lead} tel ", some(dig, r.randint(12, 16))),
            lambda: (f"{lead} ", f"20{some(dig, 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{some('01', 1)}{r.randint(0, 9)}"),
            lambda: (f"{lead} version ", f"{r.randint(0, 20)}.{r.randint(0, 99)}.{r.randint(0, 999)}-rc{r.randint(1, 9)}.{word()}"),
            lambda: (f"{lead} ", word() + word() + word() + word() + some(dig, r.randint(1, 2))),
            lambda: (f"{lead}{r.choice([':', '=', ' = '])}", word() + word() + word() + word()),
            lambda: (f"{lead} {said_of()}{r.choice([': ', ' = ', ':', '='])}", word() + r.choice(["", "", ",", ".", ";"])),
            lambda: (f"{lead} {said_of()}{put}", r.choice(["true", "false", "null", "None", "none", "required", "optional", "string", "bytes", "hidden", "changeme", "example1", "xxxxxxxx", "********", "test1234", "<password>", "<your-token>", "${SECRET}", "{{token}}", "[secret]"])),
            lambda: (f"{lead} {said_of()}{r.choice([' = ', '=', ': '])}", r.choice([f"get_{word()}()", f"self.{word()}", f"os.environ['{word().upper()}']", f"{word()}.{word()}({word()})", f"process.env.{word().upper()}", f"${{{word().upper()}}}", f"${word().upper()}", f"Optional[{word()}]"])),
            lambda: (f"{lead} {said_of()}{r.choice([': ', '='])}", r.choice([f"20{some(dig, 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(10, 23)}:{r.randint(10, 59)}", f"https://{word()}.org/{word()}", f"/{word()}/{word()}", f"{word()}@example.com"])),
            lambda: (f"{lead} ", block(r.choice(["CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST", "PGP SIGNATURE", "PGP PUBLIC KEY BLOCK"]))),
        ][kind]()
        out.append((before, value, f" {tail}", r.choice([*plain, "tests/test_x.py", "docs/guide.md", "package-lock.json"]), 0))
    return out


def train(corpus: Corpus, findings: list[tuple[str, str, str, str, int]] | None = None, max_findings: int = MAX_FINDINGS) -> Forest:
    """A forest from labelled findings (before, candidate, after, path, label), at most max_findings of them, chosen by a hash of all they say."""
    rows = findings if findings is not None else made_findings()
    if len(rows) > max_findings:
        rows = sorted(rows, key=lambda x: zlib.crc32(repr(x).encode()))[:max_findings]
    x = np.array([features(c.encode(), b.encode(), a.encode(), p, corpus) for b, c, a, p, _ in rows])
    return Forest(x, np.array([r[4] for r in rows], dtype=float))


def named_values(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Start, end and text of each value that is put behind a name with one of SECRET_WORDS."""
    at = np.flatnonzero(_PUTS[raw])
    of = np.searchsorted(offs, at, "right") - 1
    past = 0
    for p, t in zip(at.tolist(), of.tolist(), strict=True):
        lo, hi = int(offs[t]), int(offs[t + 1])
        if p < past or not _names_secret(raw[max(lo, p - _AROUND) : p].tobytes()):
            continue
        room = 256
        while (m := _VALUE.match(raw[p + 1 : min(hi, p + 1 + room)].tobytes())) is not None or room < hi - p:
            if (m is not None and m.end() < room) or room >= hi - p:
                break
            room *= 8  # the value may go on
        if m is None:
            continue
        s, e = m.span(m.lastindex)
        if m.lastindex == 3:
            e -= len(c[0]) if (c := _CLOSED.search(m[3])) else 0
        if e - s >= NAMED_LEAST and not (m.lastindex == 3 and m[3].startswith(b"//")):
            past = p + 1 + e
            yield p + 1 + s, past, t


def key_blocks(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Start, end and text of each armoured block: up to its END line or, without one, to the end of its lines."""
    text = raw.tobytes()
    if text.find(b"-----BEGIN ") < 0:
        return
    begins = [(m.start(), m.end(), m[1]) for m in _BEGIN.finditer(text)]
    ends = {name: [(m.start(), m.end()) for m in re.finditer(rb"-----END " + re.escape(name) + rb"-----", text)] for name in {b[2] for b in begins}}
    for k, (s, e, name) in enumerate(begins):
        t = int(np.searchsorted(offs, s, "right")) - 1
        stop = min(int(offs[t + 1]), begins[k + 1][0] if k + 1 < len(begins) else len(text))
        i = bisect_left(ends[name], (e,))
        past = ends[name][i][1] if i < len(ends[name]) else stop + 1
        yield s, past if past <= stop else _LINES.match(text, e, stop).end(), t


def candidates(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of all candidates by their start, longer ones first; a named value may hold others."""
    s, e, first = words(raw, offs, _JOINT)
    size = e - s
    digits, capitals = (np.concatenate([[0], np.cumsum(t[raw])]) for t in (_DIGIT, _UPPER))
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    lead = np.full(len(s), 32, np.uint8)
    for back in (1, 2, 3):  # past quotes and blanks
        at = np.maximum(s - back, 0)
        free = ((lead == 32) | (lead == 34) | (lead == 39)) & (s - back >= offs[of])
        lead[free] = raw[at[free]]
    on = (size >= LEAST) & ((digits[e] > digits[s]) | (capitals[e] - capitals[s] == size) | (lead == 0x3D) | (lead == 0x3A))
    blocks = np.array([(0, 0, 0), *key_blocks(raw, offs)], dtype=np.int64).T
    on &= e > blocks[1][np.searchsorted(blocks[0], s, "right") - 1]  # a block stands for its lines
    more = np.concatenate([np.array(list(named_values(raw, offs)), dtype=np.int64).reshape(-1, 3).T, blocks[:, 1:]], axis=1)
    s, e, of = (np.concatenate([x[on], y]) for x, y in zip((s, e, of), more, strict=True))
    order = np.lexsort((-e, s))
    order = order[np.append(True, (s[order][1:] != s[order][:-1]) | (e[order][1:] != e[order][:-1]))] if len(order) else order
    return s[order], e[order], of[order]


def _found(raw: np.ndarray, at: np.ndarray, paths: list[str], corpus: Corpus, forest: Forest, cut: float) -> tuple[np.ndarray, list[list[dict]]]:
    """Per text the count of candidates and the findings; those that overlap are one."""
    s, e, of = candidates(raw, at)
    found: list[list[dict]] = [[] for _ in range(len(at) - 1)]
    if len(s):
        rows = [features(raw[a:z].tobytes(), raw[max(at[t], a - _AROUND) : a].tobytes(), raw[z : min(at[t + 1], z + _AROUND)].tobytes(), paths[t], corpus) for a, z, t in zip(s, e, of, strict=True)]
        score = forest.predict(np.array(rows))
        for k in np.flatnonzero(score >= cut).tolist():
            own, one = found[of[k]], {"first": int(s[k] - at[of[k]]), "past": int(e[k] - at[of[k]]), "score": float(score[k])}
            if own and one["first"] < own[-1]["past"]:
                own[-1] |= {"past": max(own[-1]["past"], one["past"]), "score": max(own[-1]["score"], one["score"])}
            else:
                own.append(one)
    return np.bincount(of, minlength=len(at) - 1), found


def findings(docs: DataFrame, corpus: Corpus, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", cut: float = 0.5) -> DataFrame:
    """One row per row of docs: id_col, n_candidates, findings (first and past byte, score).

    Null and empty texts have none. Repeated rows are judged alike; null ids
    stay; an empty table gives no rows. path_col may be missing or null. Other
    columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    shared = docs.sparkSession.sparkContext.broadcast((corpus, forest))  # of a fixed size
    place = pa.struct([("first", pa.int32()), ("past", pa.int32()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = flat(b.column(1))
            paths = b.column(2).to_pylist()
            for i, j in runs(offs):
                n, found = _found(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], paths[i:j], *shared.value, cut)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(found, pa.list_(place))], ["id", "n_candidates", "findings"])

    out = bounded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.alias("path"))).mapInArrow(scan, f"id {kind}, n_candidates long, findings array<struct<first:int,past:int,score:double>>")
    return out.withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, corpus: Corpus, forest: Forest, text_col: str = "text", path_col: str | None = "source", cut: float = 0.5, put: str = "[secret]") -> DataFrame:
    """The rows of docs, all columns, with put in the place of each finding; null texts stay null."""
    docs = bounded(docs)
    shared = docs.sparkSession.sparkContext.broadcast((corpus, forest))
    at, where = docs.columns.index(text_col), docs.columns.index(path_col) if path_col in docs.columns else None

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = flat(b.column(at))
            paths = [str(x or "") for x in b.column(where).to_pylist()] if where is not None else [""] * b.num_rows
            for i, j in runs(offs):
                _, found = _found(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], paths[i:j], *shared.value, cut)
                part = b.slice(i, j - i)
                if any(found):
                    new = part.column(at).to_pylist()
                    for t, fs in enumerate(found):
                        if fs:
                            old, parts, upto = data[offs[i + t] : offs[i + t + 1]].tobytes(), [], 0
                            for f in fs:
                                parts += [old[upto : f["first"]], put.encode()]
                                upto = f["past"]
                            new[t] = b"".join([*parts, old[upto:]]).decode()
                    part = part.set_column(at, part.schema.field(at), pa.array(new, part.column(at).type))
                yield part

    return docs.mapInArrow(replace, docs.schema)
