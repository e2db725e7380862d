"""Secret scans by assignment-aware lexing.

Beside fixed patterns, source and configuration syntax is read as pairs of a name and a literal: `name = "x"`, `name: x`,
`"name": "x"`, `<name>x</name>`, `export NAME=x`. A literal is a quoted string with escapes, a triple-quoted string, a heredoc, or a bare
value; `"a" + k + "b"` joins literals and constants. Names bound to literals are constants of their scope, braces or an
indented definition; `self.`, `this.` and `$` before a name are left out. What comments and other strings hold is read as well,
but binds no constants. A literal counts as a secret by the words of the name it reaches and by how random it looks.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_A_TIME, by_batch

#: The kinds of the fixed patterns, in the order in which ties are listed; what the method adds comes last.
KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
HINTS = ("passw", "secret", "token", "api")
#: Words of a name that make its literal sensitive, with their weights.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.6, "auth": 0.6, "bearer": 0.8, "key": 0.5, "access": 0.4, "signing": 0.6, "salt": 0.5, "dsn": 0.5, "cookie": 0.5}
#: Pairs of words that are one of the words above.
JOINED = (("api", "key"), ("pass", "word"), ("pass", "phrase"))
NAMED_HINTS = (*SENSITIVE, "pass")
#: Shortest literal, the score from which a literal is a secret, and how deep strings and comments are read within each other.
SHORTEST, THRESHOLD, DEPTH = 8, 0.9, 3
#: A name starts where its run of name characters does, digits and signs before it left out; possessive, so that long runs are read once.
NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
SIGN = r"[ \t]*+(?::=|=>|=(?!=)|:(?!:|//))[ \t]*+"
STRING = r"\"(?:[^\"\n\\]|\\[\s\S])*+\"|'(?:[^'\n\\]|\\[\s\S])*+'|`[^`\n]*+`"
TRIPLE = r"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"
#: What is looked for in a text; all else is passed over.
TOKEN = re.compile(
    rf"(?P<triple>{TRIPLE})|(?P<string>(?<![A-Za-z0-9])(?:{STRING})|\"(?:[^\"\n\\]|\\[\s\S])*+\")|<(?P<tag>{NAME})>(?P<body>[^<\n]++)</(?P=tag)>"
    rf"|(?<![A-Za-z0-9_.\-])[0-9.\-]*+(?P<name>{NAME})(?P<sign>{SIGN})|(?P<line>(?<![:A-Za-z0-9_&])(?:\#|//))|(?P<block>/\*)|(?P<open>\{{)|(?P<close>\}})|(?m:^)(?P<indent>[ \t]*+)(?:def|class)\b"
)
AFTER = re.compile(SIGN)
TERM = re.compile(rf"(?P<prefix>[bBrRuUfF]{{0,2}}+)(?:(?P<triple>{TRIPLE})|(?P<string>{STRING}))|<<[-~]?(?P<mark>[\"']?)(?P<here>[A-Za-z_]\w*)(?P=mark)[^\n]*\n|\$?(?P<bare>[A-Za-z0-9+/_.=\-]++)")
PLUS = re.compile(r"[ \t]*+\+[ \t]*+(?:\\?\n[ \t]*+)?|[ \t]++\.\.?[ \t]++|[ \t]++(?=[\"'])")
PLUS_IN_BRACKETS = re.compile(r"\s*+\+\s*+|\s++\.\.?\s++|\s++(?=[\"'])")
SOLE_WORD = re.compile(r"^[ \t]*([A-Za-z_]\w*)[ \t]*$", re.M)
INDENT = re.compile(r"[ \t]*")
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
RESULT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_named", pa.int64())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points."""
    out = []
    low = text.lower() if not text.isascii() or any(h in text.lower() for h in HINTS) else ""
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def sensitive(name: str) -> float:
    words = [w.lower() for w in SPLIT.split(name) if w]
    joined = [a + b for a, b in zip(words, words[1:]) if (a, b) in JOINED]
    return min(1.0, sum(SENSITIVE.get(w, 0.0) for w in {*words, *joined}))


def score(name: str, literal: str, quoted: bool = False) -> float:
    """Weight of the name times the strength of the literal, which a long random one has above 1, so that a name of little weight
    reaches the threshold by itself; placeholders and short literals get 0, and so do literals with white space, unless they are quoted
    under a name of full weight: pass phrases."""
    if len(literal) < SHORTEST or literal.lower().strip("<>*x.-") in ("", "changeme", "example", "password", "placeholder"):
        return 0.0
    weight = sensitive(name)
    if not weight or any(c.isspace() for c in literal) and not (quoted and weight >= 1.0):
        return 0.0
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return weight * (entropy(literal) / 3.0) * (0.7 + 0.25 * kinds)


Pieces = list[tuple[str, int, int]]


class Lexer:
    """One pass over a text; best holds the spans of literals that reach a sensitive name."""

    def __init__(self, text: str, threshold: float) -> None:
        self.text, self.threshold = text, threshold
        self.scopes: list[tuple[int | None, dict[str, Pieces]]] = [(None, {})]  # indentation of a definition, constants
        self.best: dict[tuple[int, int], float] = {}
        self.marks: dict[str, list[int]] | None = None

    def constant(self, name: str) -> Pieces | None:
        for _, names in reversed(self.scopes):
            if name in names:
                return names[name]
        return None

    def here_end(self, word: str, at: int) -> int | None:
        """Where the line that closes a heredoc starts."""
        if self.marks is None:  # lines of a single word, found once
            self.marks = {}
            for m in SOLE_WORD.finditer(self.text):
                self.marks.setdefault(m[1], []).append(m.start())
        own = self.marks.get(word, [])
        i = bisect.bisect_left(own, at)
        return own[i] if i < len(own) else None

    def term(self, at: int, end: int) -> tuple[Pieces | None, bool, int] | None:
        """(pieces, quoted, end) of a literal or a constant; pieces is None for a name that is not known."""
        m = TERM.match(self.text, at, end)
        if not m:
            return None
        if m["triple"] or m["string"]:
            q = 3 if m["triple"] else 1
            s, e = m.start("triple" if m["triple"] else "string") + q, m.end() - q
            return [(self.text[s:e], s, e)], True, m.end()
        if m["here"]:
            stop = self.here_end(m["here"], m.end())
            if stop is None or stop > end:
                return None
            return [(self.text[m.end() : max(m.end(), stop - 1)], m.end(), max(m.end(), stop - 1))], True, stop
        bare, s = m["bare"], m.start("bare")
        if bare.endswith("+") and self.text[m.end() : m.end() + 1] in ("'", '"') and m.end() < end:  # k+"literal"
            bare = bare.rstrip("+")
        got = self.constant(normal(bare))
        if got is None and s > at:  # a variable that is not known
            return None, False, s + len(bare)
        return got or [(bare, s, s + len(bare))], got is not None and any(" " in p[0] for p in got), s + len(bare)

    def value(self, at: int, end: int) -> tuple[Pieces, bool, int] | None:
        """The literal that an expression makes, of its pieces."""
        plus = PLUS
        if self.text[at : at + 1] == "(" and at < end:
            plus, at = PLUS_IN_BRACKETS, at + 1
            while at < end and self.text[at].isspace():
                at += 1
        got = self.term(at, end)
        if not got:
            return None
        terms, at = [got], got[2]
        while (m := plus.match(self.text, at, end)) and (got := self.term(m.end(), end)):
            terms.append(got)
            at = got[2]
        if len(terms) == 1:
            return (terms[0][0], terms[0][1], at) if terms[0][0] else None
        # a bare word within a sum is a variable: what it holds if it is known, else nothing
        known = [t for t in terms if t[0] and (t[1] or self.constant(normal(t[0][0][0])) is not None or len(t[0]) > 1 or self.text[t[0][0][1] - 1] in "\"'`")]
        return ([p for t in known for p in t[0]], True, at) if known else None

    def pair(self, name: str, at: int, end: int, bind: bool) -> int | None:
        got = self.value(at, end)
        if not got:
            return None
        pieces, quoted, stop = got
        self.reach(name, pieces, quoted)
        if bind:
            self.scopes[-1][1][normal(name)] = pieces
        return stop

    def reach(self, name: str, pieces: Pieces, quoted: bool) -> None:
        worth = score(name, "".join(p[0] for p in pieces), quoted)
        for _, s, e in pieces:
            if worth >= self.threshold and e > s:
                self.best[s, e] = worth

    def read(self, at: int, end: int, bind: bool = True, depth: int = 0) -> None:
        text, line, blocks = self.text, at, True
        while m := TOKEN.search(text, at, end):
            start, before, at = m.start(), at, max(m.end(), at + 1)
            new = text.rfind("\n", before, start)
            if new >= 0:
                line = new + 1
            if bind and self.scopes[-1][0] is not None and m.lastgroup != "indent":
                own = INDENT.match(text, line).end() - line
                while self.scopes[-1][0] is not None and own <= self.scopes[-1][0]:
                    self.scopes.pop()
            kind = m.lastgroup
            if kind in ("string", "triple"):
                q = 3 if kind == "triple" else 1
                s, e = m.start() + q, m.end() - q
                sign = AFTER.match(text, m.end(), end)
                stop = self.pair(text[s:e], sign.end(), end, bind) if sign and kind == "string" and 0 < e - s <= 256 else None
                if stop is not None:
                    at = max(stop, at)
                elif depth < DEPTH:
                    self.read(s, e, False, depth + 1)
            elif kind == "body":
                self.reach(m["tag"], [(m["body"], m.start("body"), m.end("body"))], True)
                if bind:
                    self.scopes[-1][1][normal(m["tag"])] = [(m["body"], m.start("body"), m.end("body"))]
            elif kind == "sign":
                at = self.pair(m["name"], m.end(), end, bind) or at
            elif kind == "line":
                stop = text.find("\n", m.end(), end)
                stop = end if stop < 0 else stop
                if depth < DEPTH:
                    self.read(m.end(), stop, False, depth + 1)
                    at = stop
            elif kind == "block" and blocks and depth < DEPTH:
                stop = text.find("*/", m.end(), end)
                blocks = stop >= 0
                if blocks:
                    self.read(m.end(), stop, False, depth + 1)
                    at = stop + 2
            elif kind == "open" and bind:
                self.scopes.append((None, {}))
            elif kind == "close" and bind:
                while len(self.scopes) > 1 and self.scopes[-1][0] is not None:
                    self.scopes.pop()
                if len(self.scopes) > 1:
                    self.scopes.pop()
            elif kind == "indent" and bind:
                own = len(m["indent"])
                while self.scopes[-1][0] is not None and own <= self.scopes[-1][0]:
                    self.scopes.pop()
                self.scopes.append((own, {}))


def normal(name: str) -> str:
    return re.sub(r"^(?:self|this|cls)\.", "", name)


def named_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """Spans of literals that reach a sensitive name, straight or through constants."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    low = text.lower()
    if not any(h in low for h in NAMED_HINTS):  # every sensitive name holds one of these
        return []
    lexer = Lexer(text, threshold)
    lexer.read(0, len(text))
    return sorted((s, 3, e) for s, e in lexer.best)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_named of every row's whole text.

    A null text is an empty one: counts 0, the digest of an empty string, no spans. Equal rows are scanned each for itself."""

    def run(x: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k.name: [] for k in RESULT}
        out["doc_id"] = x["doc_id"]
        for text in x["text"]:
            base, more = base_spans(text or ""), named_spans(text or "")
            kinds = Counter(k for _, k, _ in base)
            for i, k in enumerate(KINDS[:3]):
                out[f"n_{k}"].append(kinds[i])
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(sorted(base + more)))
            out["n_named"].append(len(more))
        return out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(by_batch(run, RESULT), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long")


def redacted(text: str, mark: str) -> str:
    """text with each secret, overlaps merged, replaced by mark. A name before a secret stays."""
    spans = []
    for s, k, e in base_spans(text) + named_spans(text):
        spans.append((ASSIGN.match(text, s).start(2) if k == 0 else s, e))
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with secrets replaced in every text, n_chars (if there is such a column) counted anew for texts that changed. All
    rows and columns stay; a null text stays null. Equal rows come out equal; of overlapping secrets one mark stands for all."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_A_TIME):
                yield marked(whole.slice(at, ROWS_AT_A_TIME))

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        i = batch.schema.get_field_index("text")
        texts = batch.column(i).to_pylist()
        new = [t and redacted(t, mark) for t in texts]
        batch = batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))
        j = batch.schema.get_field_index("n_chars")
        if j >= 0:
            n = [old if a == b else len(b) for old, a, b in zip(batch.column(j).to_pylist(), texts, new, strict=True)]
            batch = batch.set_column(j, batch.schema.field(j), pa.array(n, batch.schema.field(j).type))
        return batch

    return docs.mapInArrow(run, docs.schema)
