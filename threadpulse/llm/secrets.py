"""Secret scans by assignment-aware lexing."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, in_batches, sha256, text_of

#: The base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words of a name that make its literal a secret, with their weight.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "auth": 1.5, "private": 1.0, "access": 1.0, "key": 1.5, "signature": 1.0, "salt": 1.5, "bearer": 2.0}
#: Literals that only stand for a secret.
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "undefined", "your", "xxxx", "todo", "test"}

NAME = r"[A-Za-z_$][\w$]*+(?:[.-][A-Za-z_$][\w$]*+)*+"
IS_NAME = re.compile(NAME, re.A)
#: tokens of source and configuration syntax; what none of them begins is passed over
TOKEN = re.compile(rf"""(?P<line>\n[ \t]*)|(?P<comment>(?<![^\s;{{}}(,])(?:\#|//|--(?=\s)|/\*|<!--))|(?P<name>{NAME})|(?P<number>\d[\w.]*+)|(?P<quote>\"\"\"|'''|["'`])|(?P<op>:=|=>|[=!<>]=|\+=|=|:(?!//))|(?P<punct>[{{}}\[\]])""", re.A)
STRINGS = {q: re.compile(rf"{q}((?:[^{q}\\\n]++|\\[\s\S])*+){q}") for q in "\"'`"}
#: an unquoted value; what joins operands; an annotation between a name and its value; a value that only names a variable
BARE = re.compile(r"""[^\s"'`,;{}()<>\[\]]++""")
JOIN = re.compile(r"[ \t]*(?:\\?\n[ \t]*)?(?:\+(?!=)|\.\.|\.(?=\s)|&(?=\s)|\|\|)[ \t]*(?:\\?\n[ \t]*)?")
SPACE, SPACES = re.compile(r"[ \t]*+(?:\\\n[ \t]*+)?"), re.compile(r"\s*+")
ANNOTATION = re.compile(r"[ \t]*+[A-Za-z_][\w.\[\]|, \t]*+=(?!=)", re.A)
VARIABLE = re.compile(rf"\$\{{?({NAME})\}}?|\{{({NAME})\}}", re.A)
OWN_PAIR = re.compile(r":(?!//)\S|[ \t]*+(?::=|=>|=(?!=))")
STRING_PREFIX = re.compile(r"(?:[rbfu]|br|rb|fr|rf)(?=[\"'])", re.I)
ATTRIBUTE = re.compile(r"""\b(?:key|name)[ ]*+=[ ]*+["'](?P<name>[\w.-]++)["'][ ]++value[ ]*+=[ ]*+["'](?P<value>[^"'\n]++)["']""", re.A)
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.-]*+)>(?P<value>[^<>]++)</(?P=name)>", re.A)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: a text without any of these has no sensitive name, so it isn't lexed
SOME_NAME = (*SENSITIVE, "authorization")

#: begin and end lines of private keys, and what follows a begin line without its end
KEY_MARK = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]{0,40}?PRIVATE KEY(?: BLOCK)?-----", re.A)
KEY_BODY = re.compile(r"(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+", re.A)
SCHEME = re.compile(r"\s*(?:bearer|basic|token|digest|apikey)\s+(?=\S)", re.I | re.A)
SCHEME_WORD = re.compile(r"\s*(?:bearer|basic|token|digest|apikey)\s*", re.I | re.A)
#: Words of messages about a secret, which a pass phrase is told from by
MESSAGE = frozenset("please enter your must should invalid incorrect forgot forgotten required missing expired".split())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches; kind 0 assign, 1 access, 2 hex."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_weight(name: str) -> float:
    """How sensitive a target name is, by its words (snake, camel and dotted spellings)."""
    parts = [p.lower() for p in PARTS.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:])}
    return max([0.0, *(SENSITIVE.get(p, 0.0) for p in [*parts, *joined])]) + (1.5 if {"private", "access", "secret", "api", "auth"} & set(parts) and "key" in parts else 0.0)


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def literal_weight(value: str) -> float:
    """How much a literal looks like a secret: length, mixture of characters, entropy; placeholders and plain words don't."""
    if len(value) < 6 or value.lower().strip("<>{}$ ") in PLACEHOLDERS or len(set(value)) < 4 or value.startswith(("${", "{{", "<", "http://", "https://")):
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9\s]"))
    return (min(len(value), 32) / 32 + min(entropy(value), 4.0) / 4 + kinds / 4) * (0.3 if kinds == 1 and value.isalpha() else 1.0) * (0.2 if " " in value else 1.0)


def is_pass_phrase(name: str, value: str) -> bool:
    """Whether a literal of several words is a secret of its own: its name ends in a word of weight 2.5 or more, and it isn't a message."""
    words = value.split()
    if len(words) < 2 or len(value) < 10 or len(set(value)) < 4:
        return False
    last = [p.lower() for p in PARTS.findall(name)][-2:]
    return bool(last) and max(SENSITIVE.get(last[-1], 0.0), SENSITIVE.get("".join(last), 0.0)) >= 2.5 and not MESSAGE & {w.lower().strip(".,:;!?'") for w in words}


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Private keys from their begin to their end line; without an end, up to the last base64 line."""
    if "PRIVATE KEY" not in text:
        return []
    marks, out = list(KEY_MARK.finditer(text)), []
    for m, after in zip(marks, [*marks[1:], None]):
        if m[1] == "BEGIN":
            out.append((m.start(), after.end() if after and after[1] == "END" else KEY_BODY.match(text, m.end()).end()))
    return out


class Lexer:
    """Name-literal pairs of a text, in one pass from left to right.

    A value is a sum of operands: literals (their spans, without quotes) and names. Strings may hold escapes, three quotes span lines,
    comments are told apart: what they assign is a pair, but no constant. Braces and the bodies of def and class are scopes. A name is looked up
    from the innermost scope outwards, the last definition before its use, else (use before definition) the first one after."""

    def __init__(self, text: str):
        self.text = text
        self.pairs: list[tuple[str, int, int, list]] = []  # name, scope, place, operands
        self.defined: dict[tuple[int, str], list[int]] = {}
        self.parent = [-1]
        self._no_end: set[str] = set()
        self._lex()

    def _find_end(self, mark: str, at: int) -> int:
        """Where `mark` next stands, or -1; once there is none it isn't searched again."""
        if mark in self._no_end:
            return -1
        end = self.text.find(mark, at)
        if end < 0:
            self._no_end.add(mark)
        return end

    def _string(self, at: int) -> tuple[int, int, int] | None:
        """Start and end of the content, and where to go on, of the string that a quote opens here; None if it doesn't."""
        text, quote = self.text, self.text[at]
        if text.startswith(quote * 3, at):
            end = self._find_end(quote * 3, at + 3)
            if end >= 0:
                return at + 3, end, end + 3
        m = STRINGS[quote].match(text, at)
        return (*m.span(1), m.end()) if m else None

    def _value(self, at: int) -> tuple[list | None, int]:
        """Operands of the value here and where to go on; None where it is a call or an assignment of its own."""
        text, n, out, depth = self.text, len(self.text), [], 0
        at = SPACE.match(text, at).end()
        while at < n:
            c, quoted = text[at], False
            prefix = STRING_PREFIX.match(text, at)
            start = prefix.end() if prefix else at
            got = self._string(start) if start < n and text[start] in "\"'`" else None
            if got:
                inner = VARIABLE.fullmatch(text, got[0], got[1])
                out.append((got[0], got[1], inner[1] or inner[2] if inner else None))
                at, quoted = got[2], True
            elif c == "(" and not out:
                depth, at = depth + 1, SPACES.match(text, at + 1).end()
                continue
            else:
                m = BARE.match(text, at)
                if not m:
                    break
                run, name = m[0], IS_NAME.match(text, at)
                if name and name.end() < n and text[name.end()] == "(":
                    return None, name.end()
                if name and OWN_PAIR.match(text, name.end()):
                    return None, at
                names = run.split("+")
                variable = VARIABLE.fullmatch(run)
                if variable:
                    out.append((at, m.end(), variable[1] or variable[2]))
                elif all(IS_NAME.fullmatch(x) for x in names):
                    place = at
                    for x in names:
                        out.append((place, place + len(x), x))
                        place += len(x) + 1
                else:
                    out.append((at, at + len(run.rstrip(".")), None))
                at = m.end()
                if len(out) == 1 and SCHEME_WORD.fullmatch(run):
                    nxt = BARE.match(text, SPACE.match(text, at).end())
                    if nxt:
                        out[0] = (*out[0][:2], None)
                        out.append((*nxt.span(), None))
                        at = nxt.end()
            join = JOIN.match(text, at)
            if join:
                at = join.end()
                continue
            after = (SPACES if depth else SPACE).match(text, at).end()
            ahead = STRING_PREFIX.match(text, after)
            ahead = ahead.end() if ahead else after
            if quoted and ahead < n and text[ahead] in "\"'" and ahead > at:
                at = after
                continue
            break
        return out, at

    def _lex(self) -> None:
        text, at, scope, stack, comment = self.text, 0, 0, [], -1
        name: tuple[str, bool] | None = None
        bracket = False
        while True:
            m = TOKEN.search(text, at)
            if not m:
                return
            kind, at = m.lastgroup, m.end()
            if kind == "line":
                name = None
                indent = len(m[0]) - 1
                if at < len(text) and text[at] not in "\n\r#":
                    while stack and stack[-1][1] is not None and stack[-1][1] >= indent:
                        scope = stack.pop()[0]
            elif kind == "comment":
                if m.start() >= comment:
                    close = {"/*": "*/", "<!--": "-->"}.get(m[0])
                    end = self._find_end(close, at) if close else text.find("\n", at)
                    comment = end if end >= 0 else (-1 if close else len(text))
                name = None
            elif kind == "name":
                word = m[0]
                if word in ("def", "class") and m.start() >= comment:
                    line = text.rfind("\n", 0, m.start()) + 1
                    if not text[line : m.start()].strip():
                        stack.append((scope, m.start() - line))
                        self.parent.append(scope)
                        scope = len(self.parent) - 1
                name = (word, False)
            elif kind == "quote":
                before = text[m.start() - 1] if m.start() else " "
                got = None if m[0][0] == "'" and before.isalnum() and not (name and STRING_PREFIX.fullmatch(name[0] + "'", 0, len(name[0]))) else self._string(m.start())
                if got is None:
                    at = m.start() + 1
                    name = None
                else:
                    name, at = (text[got[0] : got[1]], True), got[2]
            elif kind == "punct":
                if m[0] == "{":
                    stack.append((scope, None))
                    self.parent.append(scope)
                    scope = len(self.parent) - 1
                elif m[0] == "}":
                    while stack:
                        scope, was = stack.pop()
                        if was is None:
                            break
                elif m[0] == "]" and name and name[1]:
                    bracket = True  # headers["name"] =
                    continue
                if m[0] != "]":
                    name = None
            elif kind == "op":
                if name and m[0] not in ("==", "!=", "<=", ">="):
                    if m[0] == ":" and not name[1]:
                        note = None if m.start() < comment else ANNOTATION.match(text, at)
                        at = note.end() if note and not name_weight(note[0]) else at
                    operands, at = self._value(at)
                    if operands:
                        self.pairs.append((name[0], scope, m.start(), operands))
                        if m.start() >= comment and not bracket:
                            self.defined.setdefault((scope, name[0]), []).append(len(self.pairs) - 1)
                name = None
            bracket = False

    def look_up(self, name: str, scope: int, place: int) -> int | None:
        for word in dict.fromkeys((name, name.rsplit(".", 1)[-1])):
            s = scope
            while s >= 0:
                found = self.defined.get((s, word))
                if found:
                    k = bisect.bisect_left(found, place, key=lambda i: self.pairs[i][2])
                    return found[k - 1] if k else found[0]
                s = self.parent[s]
        return None

    def literals(self, i: int) -> list[tuple[int, int]]:
        """Spans of the literals that reach the i-th pair's name, each once, in their order; a name without definition that is the whole value stands for itself."""
        _, _, _, own = self.pairs[i]
        out: dict[tuple[int, int], None] = {}
        seen, todo = {i}, [(i, x) for x in reversed(own)]
        while todo:
            k, (a, b, name) = todo.pop()
            if name is None:
                if b > a:
                    out[a, b] = None
                continue
            j = self.look_up(name, self.pairs[k][1], self.pairs[k][2])
            if j is None:
                if len(self.pairs[k][3]) == 1 and b > a:
                    out[a, b] = None
            elif j not in seen:
                seen.add(j)
                todo += [(j, x) for x in reversed(self.pairs[j][3])]
        return list(out)


def method_spans(text: str, threshold: float = 4.0) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name, directly or through constants, whose score (name weight x literal weight) is at least `threshold`
    or that are pass phrases; a scheme before a token (Bearer ...) isn't scored. Private key blocks need no name."""
    found = set(key_blocks(text))
    low = text.lower()
    if not any(x in low for x in SOME_NAME) or not (":" in text or "=" in text or "</" in text):
        return sorted(found)

    def judge(name: str, parts: list[tuple[int, int]]) -> None:
        w = name_weight(name)
        if not parts or not (w or "authorization" in name.lower()):
            return
        value = "".join(text[a:b] for a, b in parts)
        if len(parts) > 1 and SCHEME_WORD.fullmatch(text, *parts[0]):
            value = text[slice(*parts[0])] + " " + value[parts[0][1] - parts[0][0] :]
        scheme = SCHEME.match(value)
        if scheme:
            w, value = max(w, SENSITIVE["bearer"]), value[scheme.end() :]
        if w and (w * literal_weight(value) >= threshold or is_pass_phrase(name, value)):
            found.update(p for p in parts if not SCHEME_WORD.fullmatch(text, *p))

    lexed = Lexer(text)
    for i, (name, _, _, _) in enumerate(lexed.pairs):
        if name_weight(name) or "authorization" in name.lower():
            judge(name, lexed.literals(i))
    for rule in (ATTRIBUTE, ELEMENT):
        for m in rule.finditer(text):
            judge(m["name"], [m.span("value")])
    return sorted(found)


def scan(text: str) -> list[tuple[int, str, int]]:
    """All spans as (start, kind, end) by start: the base ones and those that the lexer adds outside of them."""
    base = base_spans(text)
    out = [(a, ("assign", "access", "hex")[k], b) for a, k, b in base]
    reach, j, i = -1, 0, 0
    for a, b in method_spans(text):
        while i < len(base) and base[i][0] <= a:
            reach = max(reach, base[i][2])
            i += 1
        if b > reach:
            out.append((a, "literal", b))
    order = {"assign": 0, "access": 1, "hex": 2, "literal": 3}
    return sorted(out, key=lambda s: (s[0], order[s[1]], s[2]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal.

    Null text counts as empty: no spans, the hash of the empty string. Repeated rows each give a row; other columns,
    whatever their names, are not read. An empty table gives an empty result. Spans count code points.
    """

    def f(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc, text in zip(frame["doc_id"], frame["text"]):
            spans = scan(text_of(text))
            named = [f"{k}:{a}:{b}" for a, k, b in spans]
            n = Counter(k for _, k, _ in spans)
            base = ",".join(x for x in named if x[0] != "l")
            rows.append((doc, n["assign"], n["access"], n["hex"], sha256(base), ",".join(named), n["literal"]))
        return pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"]).astype({"doc_id": "Int64"})

    return in_batches(docs.select("doc_id", "text"), f, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, at, upto = [], 0, -1
    for a, _, b in scan(text):
        if a >= upto:
            out += [text[at:a], mark]
        at = upto = max(upto, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with all secrets replaced by a mark and n_chars counted anew; null texts and other columns stay as they are."""
    schema = docs.schema
    want = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(want.names)}
            new = [None if t is None else redact(t) for t in columns["text"].to_pylist()]
            columns["text"] = pa.array(new, want.field("text").type)
            if "n_chars" in columns:
                counts = [n if t is None else len(t) for t, n in zip(new, columns["n_chars"].to_pylist())]
                columns["n_chars"] = pa.array(counts, want.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in want.names], schema=want)

    return docs.mapInArrow(run, schema)
