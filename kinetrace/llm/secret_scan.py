"""Secret scan by assignment-aware lexing.

Source code and configuration are read as assignments: a target name, an operator (``=``, ``:=``, ``=>``, ``:``) and an
expression of terms (quoted literals in any common quoting, bare configuration values, names) joined by ``+``, ``.``
or adjacency. Names stand for the constants assigned to them anywhere in the same text (the nearest assignment
before the use, else the first one after it), through any number of steps, so ``k = "..."; api_key = k`` is found at
the literal; assignments that refer to each other in a circle have all their constants together. An expression is scored by
its target's sensitivity and by the look of the whole that its constants make (length, character classes, entropy; placeholders score 0, white
space lowers); each of its constants is a finding from ``LEAST_SCORE``, under the name of the best scored assignment that it reaches. A literal that is
none is read as a text of its own, its escapes resolved, so assignments in embedded scripts and configurations are found. An
unquoted value after ``Bearer`` or ``Basic`` is a literal. A placeholder is one as a whole; nothing is too long or too short to be scored.

Scale: every text is judged alone, one scan, no shuffle; a text without an operator is passed over by one search.
The work is linear in the text, times the depth of literals within literals: targets are read backwards from the operators over
disjoint stretches, names are found by bisection, and what an assignment amounts to is summed once, from its sources' sums,
in the order of strongly connected components; scores go down the same way.

Defined edge cases: null and empty texts have no findings, an empty table no rows; long texts, names and literals are read whole; repeated rows are judged alike;
in ``a: b = "x"`` both names are targets of the literal; a bare value ends where another assignment to a sensitive name begins in it; spans are character offsets of the literal
without its quotes; of assignments with one score that reach one literal the first is reported; only the text column is read, extra columns are kept, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_SCORE = 60
MASK = "[secret]"

_OPERATOR = re.compile(r"(?<![=!<>:+\-*/%&|^~?])(?::=|=>|=(?![=~])|:(?![:=/]))")
_BACKWARDS = re.compile(r"[\w$@.:>\-]+")
_TYPE = re.compile(r"[\w.\[\]<>]+")
_SPACE = re.compile(r"[ \t]*")
_LITERAL = re.compile(r'''(?:[rRbBuUfF]{1,2}|@)?(?:"""(?P<a>[\s\S]*?)"""|\'\'\'(?P<b>[\s\S]*?)\'\'\'|"(?P<c>(?:[^"\\\n]|\\.)*)"|'(?P<d>(?:[^'\\\n]|\\.)*)'|`(?P<e>[^`\n]*)`)''')
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*(?![\w$])(?=(?:\+|\.\.?|\\)?(?:[\s\"'`,;#(){}\[\]<>]|\Z))")
_BARE = re.compile(r"""[^\s"'`,;#(){}\[\]<>]+""")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.|\.(?=[ \t]*[\"'$])|\\\n)[ \t]*\n?[ \t]*|[ \t]+(?=[\"'])")

#: Words of a name, or two in a row, and how sensitive they make it.
_SENSITIVE = {
    "password": 100, "passwd": 100, "pwd": 90, "passphrase": 100, "secret": 95, "token": 90, "apikey": 95, "credential": 80, "credentials": 80,
    "auth": 60, "authorization": 80, "bearer": 80, "privatekey": 100, "accesskey": 95, "secretkey": 100, "signingkey": 95, "encryptionkey": 95, "authkey": 95,
    "connectionstring": 75, "dsn": 60, "jwt": 85, "pin": 50, "salt": 60, "cookie": 55, "session": 45, "webhook": 55, "masterkey": 95, "clientkey": 80, "sharedkey": 90, "accountkey": 90,
}
_HARMLESS = {"tokenizer", "public", "count", "length", "len", "size", "path", "file", "url", "name", "type", "id", "limit", "max", "min", "prefix", "field", "label", "hint", "regex", "policy", "expiry", "expires", "ttl"}
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: A literal made of these words alone says what belongs in its place.
_STANDS_FOR = frozenset(
    "change me changeme example examples placeholder your my the a an dummy redacted insert todo fixme default sample test here key keys api token secret password passwd value goes enter none null nil true false undefined"
    " replace this with xxx string foo bar username user".split()
)
_TEMPLATE = re.compile(r"<[^<>]*>|\{[^{}]*\}|\{\{[^{}]*\}\}|\[[^\[\]]*\]|\$\{[^{}]*\}|\$\([^()]*\)|\$[A-Z_][A-Z0-9_]*|%[A-Za-z_]+%|%\([A-Za-z_]+\)[sd]|x+|X+")
_SPLIT = re.compile(r"[^\w]+|_+")
_SCHEME = re.compile(r"(?i)(?:bearer|basic)[ \t]+(?=[^\s\"'`,;#(){}\[\]<>])")
_ESCAPE = re.compile(r"\\([\s\S])")
_OPENINGS = ("-----BEGIN", "Bearer ", "Basic ")


def name_score(name: str) -> int:
    """0-100: how sensitive a target of this name is."""
    parts = [w.lower() for w in _WORDS.findall(name)]
    best = max([_SENSITIVE.get(a, 0) for a in parts] + [_SENSITIVE.get(a + b, 0) for a, b in zip(parts, parts[1:], strict=False)], default=0)
    return best // 2 if best and parts and parts[-1] in _HARMLESS else best


def is_placeholder(text: str) -> bool:
    """Whether the whole text is a template, one character over and over, or nothing but words that stand for a value."""
    if len(set(text)) <= 1 or _TEMPLATE.fullmatch(text):
        return True
    parts = [p for p in _SPLIT.split(text.lower()) if p]
    return bool(parts) and all(p.rstrip("0123456789") in _STANDS_FOR for p in parts)


@dataclass
class Look:
    """What constants in a row look like together; sums of looks are looks."""

    counts: dict[str, float] = field(default_factory=dict)
    quoted: bool = True
    placeholder: bool = True
    label: bool = False  # a sentence that names the secret
    opening: str = ""

    def add(self, other: Look) -> None:
        for c, n in other.counts.items():
            self.counts[c] = self.counts.get(c, 0) + n
        if self.counts and max(self.counts.values()) > 1e12:  # doubled at each step of a chain: only the shares count
            self.counts = {c: n / 1e6 for c, n in self.counts.items()}
        self.quoted &= other.quoted
        self.placeholder &= other.placeholder
        self.label |= other.label
        self.opening = (self.opening + other.opening)[:10]

    def score(self) -> int:
        """0-100: how much it looks like a secret rather than a word, a sentence or a placeholder."""
        n = sum(self.counts.values())
        if not n or self.placeholder:
            return 0
        if any(c.isspace() for c in self.counts) and self.opening.startswith(_OPENINGS):
            return 100
        bits = -sum(c / n * math.log2(c / n) for c in sorted(self.counts.values()))
        kinds = {"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "." for c in self.counts if not c.isspace()}
        spaced = any(c.isspace() for c in self.counts)
        if kinds <= {"a"} or kinds <= {"A"} or kinds <= {"."}:
            if not spaced and n < 24:
                return 40 if self.quoted else 0  # one plain word
        score = min(40, 2 * n) + min(40, int(12 * bits)) + 10 * (len(kinds) - 1) + 10 * self.quoted - 25 * spaced - 25 * (spaced and self.label)
        return int(max(0, min(100, score if self.quoted or n >= 8 and "0" in kinds else score // 3)))


_LABEL = re.compile(r"(?i)\b(?:password|passphrase|passwd|secret|token|key|credentials?)\b")


def look_of(text: str, quoted: bool) -> Look:
    return Look(dict(Counter(text)), quoted, is_placeholder(text), bool(_LABEL.search(text)), text[:10])


@dataclass
class Term:
    kind: str  # literal, bare, name or call
    start: int
    stop: int


@dataclass
class Assignment:
    name: str
    terms: list[Term]
    at: int
    begin: int  # where the target's name begins
    score: int


def assignments(text: str) -> list[Assignment]:
    """Every name-expression pair of a text, in order."""
    out: list[Assignment] = []
    tied, free, line, bare = 0, 0, 0, (0, 0)  # end of the last literal, of the last operator, start of the line, the last bare run
    typed: tuple[str, int] | None = None  # target of the colon just before
    for op in _OPERATOR.finditer(text):
        at = op.start()
        if at < tied:  # inside a literal that has been read already
            continue
        line = max(line, text.rfind("\n", free, at) + 1)
        low = max(free, tied)
        before, free = text[low:at].rstrip(), op.end()
        names: list[tuple[str, int]] = []
        inner = before[:-1].rstrip() if before.endswith("]") else before
        if inner and inner[-1] in "\"'`":
            end = low + len(inner) - 1
            start = text.rfind(inner[-1], min(line, low), end)
            if start >= 0 and start + 1 < end and "\n" not in text[start:end]:
                names.append((text[start + 1 : end], start + 1))
        elif m := _BACKWARDS.match(before[::-1]):
            name = before[len(before) - m.end() :]
            bare_name = name.strip("-.:>").lstrip("0123456789")
            if bare_name:
                names.append((bare_name, low + len(before) - m.end() + name.find(bare_name)))
            if typed and op[0] in ("=", ":=") and _TYPE.fullmatch(before.strip()):
                names.insert(0, typed)
        typed = names[-1] if names and op[0] == ":" else None
        if not names:
            continue
        terms, pos = [], _SPACE.match(text, op.end()).end()
        while True:
            if m := _LITERAL.match(text, pos):
                terms.append(Term("literal", m.start(m.lastgroup), m.end(m.lastgroup)))
                tied = m.end()
            elif not terms and (m := _SCHEME.match(text, pos)):
                m = _BARE.match(text, m.end())
                terms.append(Term("literal", m.start(), m.end()))
                tied = m.end()
            elif m := _NAME.match(text, pos):
                terms.append(Term("call" if text[m.end() : m.end() + 1] in ("(", "[") else "name", m.start(), m.end()))
            elif not terms and (bare[0] <= pos < bare[1] or (m := _BARE.match(text, pos))):
                bare = bare if bare[0] <= pos < bare[1] else m.span()
                terms.append(Term("bare", pos, bare[1]))
                break
            else:
                break
            pos = m.end()
            if not (j := _JOIN.match(text, pos)):
                break
            pos = j.end()
        if terms:
            out += [Assignment(name, [Term(t.kind, t.start, t.stop) for t in terms], at, begin, name_score(name)) for name, begin in names]
    sensitive = following = len(text)  # where the next target begins: of a sensitive assignment, of any
    later = [sensitive, following]
    for a in reversed(out):  # a bare value doesn't run into another assignment, unless it begins with its target
        t = a.terms[0]
        if t.kind == "bare":
            stop = (sensitive if sensitive > t.start else later[0]) if a.score >= 50 else (following if following > t.start else later[1])
            t.stop = min(t.stop, max(stop, t.start))
        if a.score >= 50 and a.begin < sensitive:
            sensitive, later[0] = a.begin, sensitive
        if a.begin < following:
            following, later[1] = a.begin, following
    return out


def components(sources: list[list[int]]) -> list[list[int]]:
    """Strongly connected components of a graph, sources before what depends on them (Tarjan's, without recursion)."""
    number, low, stack, held, out = [0] * len(sources), [0] * len(sources), [], [False] * len(sources), []
    tick = 0
    for root in range(len(sources)):
        if number[root]:
            continue
        work = [(root, iter(sources[root]))]
        tick += 1
        number[root] = low[root] = tick
        stack.append(root)
        held[root] = True
        while work:
            v, rest = work[-1]
            for w in rest:
                if not number[w]:
                    tick += 1
                    number[w] = low[w] = tick
                    stack.append(w)
                    held[w] = True
                    work.append((w, iter(sources[w])))
                    break
                if held[w]:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    whole = []
                    while not whole or whole[-1] != v:
                        whole.append(stack.pop())
                        held[whole[-1]] = False
                    out.append(sorted(whole))
    return out


def _unescaped(text: str) -> tuple[str, list[int] | range]:
    """The text with its escapes resolved, and where each of its characters and its end are in the text."""
    if "\\" not in text:
        return text, range(len(text) + 1)
    out, where, at = [], [], 0
    for m in _ESCAPE.finditer(text):
        out += [text[at : m.start()], {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1])]
        where += [*range(at, m.start()), m.start()]
        at = m.end()
    return "".join(out) + text[at:], [*where, *range(at, len(text) + 1)]


def find_secrets(text: str | None) -> list[tuple[str, int, int, int]]:
    """(target name, start, stop, score) of every literal that is a secret, by position."""
    if not text or ("=" not in text and ":" not in text):
        return []
    found = assignments(text)
    best: dict[tuple[int, int], tuple[int, int]] = {}  # span -> score, minus the assignment's number

    def report(t: Term, mark: tuple[int, int]) -> None:
        if t.stop > t.start and mark > best.get((t.start, t.stop), (0, 0)):
            best[t.start, t.stop] = mark

    if any(a.score >= 50 for a in found):
        _propagate(text, found, report)
    out = {span: (score, found[-i].name) for span, (score, i) in best.items()}
    for start, stop in {(t.start, t.stop) for a in found for t in a.terms if t.kind == "literal"} - best.keys():
        inner, where = _unescaped(text[start:stop])
        for name, a, b, score in find_secrets(inner):
            out[start + where[a], start + where[b]] = (score, name)
    return [(name, start, stop, score) for (start, stop), (score, name) in sorted(out.items())]


def _propagate(text: str, found: list[Assignment], report) -> None:
    """Scores every assignment to a sensitive name and reports each constant that it reaches under the best score."""
    defined: dict[str, list[int]] = {}
    for i, a in enumerate(found):
        defined.setdefault(a.name, []).append(i)
    sources: list[list[int]] = []  # of the name terms, -1 where there is none
    for i, a in enumerate(found):
        own = []
        for t in a.terms:
            if t.kind == "name":
                places = defined.get(text[t.start : t.stop], [])
                k = bisect_left(places, i)
                after = places[k:] if k == 0 else ()
                own.append(places[k - 1] if k else next((p for p in after[:2] if p > i), -1))
        sources.append(own)
    looks: list[Look] = [None] * len(found)  # type: ignore[list-item]
    order = components([[s for s in own if s >= 0] for own in sources])
    marks: list[tuple[int, int]] = [(0, 0)] * len(found)
    part: dict[tuple[int, int, str], Look] = {}
    for group in order:
        circle, total = set(group), Look()
        for i in group:
            a, named = found[i], iter(sources[i])
            for t in a.terms:
                if t.kind in ("literal", "bare"):
                    key = (t.start, t.stop, t.kind)
                    if key not in part:
                        part[key] = look_of(text[t.start : t.stop], t.kind == "literal")
                    total.add(part[key])
                elif t.kind == "name" and (s := next(named)) >= 0 and s not in circle:
                    total.add(looks[s])
        for i in group:
            looks[i] = total
            a = found[i]
            if a.score < 50:
                continue
            if len(a.terms) == 1 and a.terms[0].kind == "name" and sources[i][0] < 0:  # a bare word of a configuration file
                score = a.score * look_of(text[a.terms[0].start : a.terms[0].stop], False).score() // 100
                if score >= LEAST_SCORE:
                    report(a.terms[0], (score, -i))
            score = a.score * total.score() // 100
            if score >= LEAST_SCORE:
                marks[i] = (score, -i)
    for group in reversed(order):
        mark = max(marks[i] for i in group)
        if not mark[0]:
            continue
        for i in group:
            for t in found[i].terms:
                if t.kind in ("literal", "bare"):
                    report(t, mark)
            for s in sources[i]:
                if s >= 0:
                    marks[s] = max(marks[s], mark)


def redact(text: str | None) -> str | None:
    """The text with every secret literal masked; null where there is nothing to mask."""
    spans = find_secrets(text)
    if not spans:
        return None
    out, at = [], 0
    for _, start, stop, _ in spans:
        if start >= at:
            out += [text[at:start], MASK]
            at = stop
    return "".join(out) + text[at:]


_FINDING = pa.struct([("name", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.int32())])


def _findings(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in it:
        yield pa.array([[{"name": n, "start": a, "stop": b, "score": s} for n, a, b, s in find_secrets(t)] or None for t in texts.to_pylist()], type=pa.list_(_FINDING))


def _redacted(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in it:
        yield pa.array([redact(t) for t in texts.to_pylist()], type=pa.string())


def findings(text_col: str = "text") -> Column:
    """array<struct<name, start, stop, score>> of a text column, null where there are none."""
    return F.arrow_udf(_findings, "array<struct<name:string,start:int,stop:int,score:int>>").asNondeterministic()(F.col(text_col))


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with secret literals masked and, where that changed the text, its characters counted anew."""
    from kinetrace.llm.textkernel import fresh

    new = fresh(docs, "redacted")
    masked = docs.withColumn(new, F.arrow_udf(_redacted, "string").asNondeterministic()(F.col(text_col)))
    changed = {text_col: F.coalesce(F.col(new), F.col(text_col))}
    if chars_col in docs.columns:
        changed[chars_col] = F.when(F.col(new).isNull(), F.col(chars_col)).otherwise(F.length(new).cast(dict(docs.dtypes)[chars_col]))
    return masked.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.explode(findings()).alias("f")).select("doc_id", "f.*")
