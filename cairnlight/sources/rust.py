"""An item parser for Rust source: elements, references, imports, metrics.

It reads tokens, not types: items and their nesting exactly, expressions by
their tokens. Macro calls are opaque. Everything is local to one file.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate, compress

KEYWORDS = frozenset(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()
)
#: One alternative a kind of token; comments, white space and anything unknown are tokens too.
_TOKEN = re.compile(
    r"""\s+|//[^\n]*|/\*(?:(?!/\*|\*/)(?s:.))*\*/|/\*|b?r"[^"]*"|b?r\#"(?s:.*?)"\#|b?r\#\#"(?s:.*?)"\#\#|b?r\#*"|b?"(?:\\(?s:.)|[^"\\])*"|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'|'[A-Za-z_]\w*
    |\d(?:[\w]|\.(?=\d))*(?:[eE][+-]?\d+)?|(?:r\#)?[^\W\d]\w*
    |\.\.=|\.\.\.|<<=|>>=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|\.\.|<<|[-+*/%^!&|=<>@.,;:\#$?~{}()\[\]]|(?s:.)""",
    re.X,
)
_OPERATOR = re.compile(r"\.\.=|\.\.\.|<<=|>>=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|\.\.|<<|[-+*/%^!&|=<>@.,;:#$?~{}()\[\]]")
_BLOCK_DOC, _RAW = re.compile(r"/\*\*[^*/]|/\*!"), re.compile(r'b?r#*"')
_NAME = re.compile(r"[^\W\d]\w*")
_COMMENT = re.compile(r"/\*|\*/")
BINARY = frozenset("+ - * / % ^ & | << < > == != <= >= += -= *= /= %= ^= &= |= <<= >>= && ||".split())
OPEN, BRACKETS = {"(": ")", "[": "]", "{": "}"}, frozenset("()[]{}")
NO_OPERAND = KEYWORDS - {"self", "Self", "true", "false"}
NO_PATH = KEYWORDS - {"self", "Self", "crate", "super"}
TIGHT = frozenset(",;:.)]>?") | {"::"}
LEADING = frozenset(("::", "(", "[", "<", "&", ".", "'", "!"))
LOOPS = frozenset(("if", "while", "for", "loop"))
WALKED = BINARY | frozenset(("{", "}", "=>", "?", "("))
AFTER_NAME, BEFORE_NAME = frozenset(("::", ":")), frozenset("|::|.|let|mut|for|fn|->|as".split("|")) - {""}


class ParseError(ValueError):
    pass


#: Short texts are known by heart, up to this many in a process.
KNOWN_TEXTS = 200_000
KEPT = frozenset(("doc", "str", "char", "life", "num", "id", "op"))


class _Kinds(dict):
    """The kind of each text that a token can have, found once."""

    def __missing__(self, text: str) -> str:
        kind = self.of(text)
        if len(text) <= 24 and len(self) < KNOWN_TEXTS:
            self[text] = kind
        return kind

    @staticmethod
    def of(text: str) -> str:
        first, last = text[0], text[-1]
        if first.isspace():
            return "space"
        if first == "/":
            if text.startswith("//"):
                return "doc" if text.startswith("///") and not text.startswith("////") or text.startswith("//!") else "line"
            return "op" if len(text) == 1 or text == "/=" else "block" if len(text) == 2 else "doc" if _BLOCK_DOC.match(text) else "space"
        if last == '"':
            if first == '"' or text.startswith('b"'):
                return "str" if len(text) > 1 else "bad"
            return "raw" if _RAW.fullmatch(text) else "str"
        if last == "#" and len(text) > 1:
            return "str"
        if last == "'":
            return "char" if len(text) > 1 else "bad"
        if first == "'":
            return "life"
        if first.isdigit():
            return "num"
        if first == "_" or first.isalpha():
            return "id"
        return "op" if _OPERATOR.fullmatch(text) else "id" if _NAME.fullmatch(text) else "bad"


class _Counts(dict):
    def __missing__(self, text: str) -> int:
        n = text.count("\n")
        if len(text) <= 24 and len(self) < KNOWN_TEXTS:
            self[text] = n
        return n


_KINDS, _COUNTS = _Kinds(), _Counts()


def tokens(source: str) -> tuple[list[str], list[str], list[int]]:
    """Kinds, texts and lines of the tokens, without comments and white space.

    Sources are cut by the regular expression alone; nested block comments and
    raw strings with many marks, which it can't follow, are then read from where
    they begin.
    """
    kinds, lines = _KINDS, _COUNTS
    texts: list[str] = []
    found: list[str] = []
    at = 0
    while at < len(source):
        part = _TOKEN.findall(source, at)
        own = list(map(kinds.__getitem__, part))
        stop = min((own.index(k) for k in ("block", "raw") if k in own), default=None)
        if stop is None:
            found += own
            texts += part
            break
        texts += part[:stop]
        found += own[:stop]
        begin = at + sum(map(len, part[:stop]))
        line = 1 + source.count("\n", 0, begin)
        if kinds[part[stop]] == "raw":
            close = '"' + "#" * part[stop].count("#")
            end = source.find(close, begin + len(part[stop]))
            if end < 0:
                raise ParseError(f"line {line}: string isn't closed")
            end += len(close)
            found.append("str")
        else:
            depth, end = 1, begin + 2
            while depth:
                n = _COMMENT.search(source, end)
                if not n:
                    raise ParseError(f"line {line}: comment isn't closed")
                depth += 1 if n.group() == "/*" else -1
                end = n.end()
            found.append("doc" if _BLOCK_DOC.match(source, begin, end) else "space")
        texts.append(source[begin:end])
        at = end
    ends = list(accumulate(map(lines.__getitem__, texts), initial=1))
    if "bad" in found:
        for k, t, n in zip(found, texts, ends):
            if k == "bad":
                raise ParseError(f"line {n}: unexpected {t!r}")
    keep = list(map(KEPT.__contains__, found))
    return list(compress(found, keep)), list(compress(texts, keep)), list(compress(ends, keep))


def doc_text(raw: str) -> list[str]:
    lines = [raw[3:]] if raw.startswith("//") else raw[3:-2].split("\n")
    return [t for t in (x.strip().lstrip("*").strip() for x in lines) if t]


@dataclass
class Metrics:
    cyclomatic: int = 1
    cognitive: int = 0
    nesting: int = 0
    params: int = 0
    returns: int = 0
    operators: Counter = field(default_factory=Counter)
    operands: Counter = field(default_factory=Counter)

    @property
    def score(self) -> int:
        return max(1, 2 * self.cyclomatic + self.cognitive + self.nesting + self.returns)


class File:
    """One parsed file; rows are dicts of the schema's columns."""

    def __init__(self, source: str, module: str, include_private: bool = False, include_docs: bool = True):
        self.kinds, self.texts, self.lines = tokens(source)
        self.size = len(self.texts)
        # places next to the first and the last token may be asked for
        self.kinds += [""] * 4
        self.texts += [""] * 4
        self.lines += [self.lines[-1] if self.lines else 1] * 4
        self.include_private, self.include_docs = include_private, include_docs
        self.elements: list[dict] = []
        self.references: list[dict] = []
        self.imports: list[dict] = []
        self.parents: list[str] = []
        self.pairs = self._pairs()
        self.names = [i for i, (k, x) in enumerate(zip(self.kinds, self.texts)) if k == "id" and x not in NO_PATH]
        self._items(0, self.size, module)

    def _pairs(self) -> dict[int, int]:
        stack, out, texts = [], {}, self.texts
        for i in [i for i, x in enumerate(texts) if x in BRACKETS]:
            x = texts[i]
            if x in OPEN:
                stack.append(i)
            else:
                if not stack or OPEN[texts[stack[-1]]] != x:
                    raise ParseError(f"line {self.lines[i]}: {x} has no partner")
                out[stack.pop()] = i
        if stack:
            raise ParseError(f"line {self.lines[stack[-1]]}: {texts[stack[-1]]} isn't closed")
        return out

    def _is(self, i: int, *texts: str) -> bool:
        return self.texts[i] in texts

    def _skip_angle(self, i: int) -> int:
        """Past <...> that begins at ``i``."""
        depth = 0
        while i < self.size:
            x = self.texts[i]
            if x in OPEN:
                i = self.pairs[i]
            elif x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif x == "<<":
                depth += 2
            i += 1
        raise ParseError("angle bracket isn't closed")

    def _text(self, a: int, b: int) -> str:
        if b - a == 1:
            return self.texts[a]
        out, last, kinds, texts = [], "", self.kinds, self.texts
        for i in range(a, b):
            x = texts[i]
            tight = not out or x in TIGHT or last in LEADING or x in ("(", "[", "<", "!") and kinds[i - 1] in ("id", "op") and texts[i - 1] not in ("->", "=", "+", ":", ",")
            if not tight:
                out.append(" ")
            out.append(x)
            last = x if x == "::" or len(x) == 1 else x[-1]
        return "".join(out)

    def _items(self, i: int, end: int, module: str) -> None:
        while i < end:
            docs, attributes, start = [], [], i
            while i < end:
                if self.kinds[i] == "doc":
                    if not self.texts[i].startswith(("//!", "/*!")):
                        docs += doc_text(self.texts[i])
                    i += 1
                elif self._is(i, "#"):
                    j = i + 1 + self._is(i + 1, "!")
                    if not self._is(j, "["):
                        raise ParseError(f"line {self.lines[i]}: bad attribute")
                    attributes.append(self._text(i, self.pairs[j] + 1).replace(" ", ""))
                    i = self.pairs[j] + 1
                else:
                    break
            if i >= end:
                return
            first = i
            visibility, scope = "Private", None
            if self._is(i, "pub"):
                visibility, i = "Public", i + 1
                if self._is(i, "(") and (self._is(i + 1, "crate", "super", "self", "in")):
                    visibility, scope = "Restricted", self._text(i + 1, self.pairs[i])
                    i = self.pairs[i] + 1
            while self._is(i, "default", "async", "unsafe") or self._is(i, "const") and self._is(i + 1, "fn", "unsafe", "async", "extern") or self._is(i, "extern") and (i + 1 < end and (self.kinds[i + 1] == "str" and self._is(i + 2, "fn") or self._is(i + 1, "fn"))):
                i += 2 if self._is(i, "extern") and self.kinds[i + 1] == "str" else 1
            if i >= end:
                raise ParseError(f"line {self.lines[first]}: an item is missing")
            word = self.texts[i]
            info = {"docs": docs if self.include_docs else [], "attributes": attributes, "visibility": visibility, "scope": scope, "module": module, "line": self.lines[start if docs else first], "first": first}
            handler = {"fn": self._fn, "struct": self._struct, "enum": self._enum, "trait": self._trait, "impl": self._impl, "mod": self._mod, "use": self._use}.get(word)
            i = handler(i, end, info) if handler else self._other(i, end)

    def _other(self, i: int, end: int) -> int:
        """Past an item that has no element: to its semicolon or braces."""
        if self.kinds[i] not in ("id", "op") or self.texts[i] in (")", "]", "}", "=", ",", "=>"):
            raise ParseError(f"line {self.lines[i]}: unexpected {self.texts[i]}")
        known = self.texts[i] in ("const", "static", "type", "macro_rules", "union", "extern") or any(self._is(j, "!", "::") for j in (i + 1, i + 2)) or self._is(i, ";")
        if not known:
            raise ParseError(f"line {self.lines[i]}: unexpected {self.texts[i]}")
        value = self.texts[i] in ("const", "static", "type")
        while i < end:
            if self._is(i, ";"):
                return i + 1
            if self.kinds[i] == "op" and self.texts[i] in OPEN:
                brace = self._is(i, "{")
                i = self.pairs[i]
                if brace and not value:
                    return i + 1
            i += 1
        return end

    def _generics(self, i: int) -> tuple[list[str], int]:
        if not self._is(i, "<"):
            return [], i
        end, out, depth, begin = self._skip_angle(i), [], 0, i + 1
        for j in range(i + 1, end - 1):
            x = self.texts[j]
            depth += (x in ("<", "(", "[")) - (x in (">", ")", "]"))
            if x == "," and not depth:
                out.append(self._text(begin, j))
                begin = j + 1
        if begin < end - 1:
            out.append(self._text(begin, end - 1))
        return out, end

    def _name(self, i: int) -> str:
        if i >= self.size or self.kinds[i] != "id":
            raise ParseError(f"line {self.lines[min(i, self.size - 1)]}: a name is missing")
        return self.texts[i]

    def _emit(self, kind: str, name: str, info: dict, last: int, m: Metrics, signature: str | None = None, generics: list[str] = ()) -> str:
        number = len(self.elements)
        ident = f"{kind}_{name}_{number}"
        parent = self.parents[-1] if self.parents else None
        self.elements.append(
            {
                "element_id": ident, "element_type": kind, "name": name, "qualified_name": f"{parent or info['module']}::{name}", "signature": signature,
                "visibility": info["visibility"], "visibility_scope": info["scope"], "line_start": info["line"], "line_end": self.lines[last], "complexity": m.score,
                "cyclomatic": m.cyclomatic, "cognitive": m.cognitive, "nesting_depth": m.nesting, "parameter_count": m.params, "return_count": m.returns,
                "lines_of_code": self.lines[last] - info["line"] + 1, "halstead_n1": len(m.operators), "halstead_n2": len(m.operands),
                "halstead_total1": sum(m.operators.values()), "halstead_total2": sum(m.operands.values()), "doc_comments": info["docs"], "inline_comments": [],
                "attributes": info["attributes"], "dependencies": [], "generic_params": list(generics), "module_path": info["module"], "parent_id": parent,
                "nesting_level": len(self.parents), "ordinal": number,
            }
        )
        return ident

    def _reference(self, source: str, kind: str, text: str, line: int, scope: str) -> None:
        self.references.append({"from_element_id": source, "to_element_id": None, "reference_type": kind, "reference_text": text, "line": line, "scope": scope, "is_resolved": False})

    def _fn(self, i: int, end: int, info: dict) -> int:
        name = self._name(i + 1)
        generics, j = self._generics(i + 2)
        if not self._is(j, "("):
            raise ParseError(f"line {self.lines[i]}: parameters are missing")
        close, m = self.pairs[j], Metrics()
        depth, part = 0, False
        for k in range(j + 1, close):
            x = self.texts[k]
            depth += (x in ("<", "(", "[", "{")) - (x in (">", ")", "]", "}"))
            if x == "," and not depth:
                m.params, part = m.params + part, False
            elif not self._is(k, "#"):
                part = True
        m.params += part
        k = close + 1
        while k < end and not self._is(k, "{", ";"):
            k = self.pairs[k] + 1 if self.texts[k] in OPEN else k + 1
        if k >= end:
            raise ParseError(f"line {self.lines[i]}: a body is missing")
        last = self.pairs[k] if self._is(k, "{") else k
        if last > k:
            self._walk(k, last, m)
        if info["visibility"] == "Private" and not self.include_private:
            return last + 1
        ident = self._emit("Function", name, info, last, m, self._text(info["first"], k), generics)
        scope = "::".join([info["module"], *self.parents])
        for p in range(j + 1, k):
            if self.kinds[p] == "id" and self.texts[p][0].isupper() and not self._is(p + 1, "::") and self.texts[p] != "Self":
                self._reference(ident, "TypeUsage", self.texts[p], self.lines[p], scope)
        if last > k:
            self._body_references(k, last, ident, scope)
        return last + 1

    def _structural(self, i: int, end: int) -> tuple[list[str], int, int, bool]:
        """Generics, the place of the body, its last token, whether it has one."""
        generics, j = self._generics(i)
        while j < end and not self._is(j, "{", ";", "("):
            j = self._skip_angle(j) if self._is(j, "<") else j + 1
        if j >= end:
            raise ParseError(f"line {self.lines[i - 1]}: a body is missing")
        if self._is(j, ";"):
            return generics, j, j, False
        return generics, j, self.pairs[j], True

    def _parts(self, a: int, b: int) -> list[tuple[int, int]]:
        """Comma-separated stretches between two brackets."""
        out, depth, begin, j = [], 0, a + 1, a + 1
        while j < b:
            x = self.texts[j]
            if self.kinds[j] == "op" and x in OPEN:
                j = self.pairs[j]
            elif self.kinds[j] == "op":
                depth += (x == "<") - (x == ">")
                if x == "," and depth <= 0:
                    out.append((begin, j))
                    begin = j + 1
            j += 1
        return out + ([(begin, b)] if begin < b else [])

    def _struct(self, i: int, end: int, info: dict) -> int:
        name = self._name(i + 1)
        generics, body, last, has = self._structural(i + 2, end)
        parts = self._parts(body, last) if has else []
        m = Metrics(1 + len(parts) // 3 + len(generics), len(parts) // 2 + len(generics))
        done = last
        if has and self._is(body, "("):
            while not self._is(done, ";"):
                done += 1
                if done >= end:
                    raise ParseError(f"line {self.lines[i]}: a semicolon is missing")
        if info["visibility"] != "Private" or self.include_private:
            ident = self._emit("Struct", name, info, done, m, self._text(info["first"], body), generics)
            for a, b in parts:
                for p in range(a, b):
                    if self.kinds[p] == "id" and self.texts[p][0].isupper():
                        self._reference(ident, "TypeUsage", self.texts[p], self.lines[p], info["module"])
        return done + 1

    def _enum(self, i: int, end: int, info: dict) -> int:
        name = self._name(i + 1)
        generics, body, last, has = self._structural(i + 2, end)
        if not has or not self._is(body, "{"):
            raise ParseError(f"line {self.lines[i]}: variants are missing")
        parts = self._parts(body, last)
        data = sum(any(self._is(p, "(", "{") for p in range(a, b) if not (p > a and self._is(p - 1, "#"))) for a, b in parts)
        if info["visibility"] != "Private" or self.include_private:
            self._emit("Enum", name, info, last, Metrics(len(parts), len(parts) + data), self._text(info["first"], body), generics)
        return last + 1

    def _trait(self, i: int, end: int, info: dict) -> int:
        name = self._name(i + 1)
        generics, body, last, has = self._structural(i + 2, end)
        if not has:
            raise ParseError(f"line {self.lines[i]}: a body is missing")
        methods = types = 0
        j = body + 1
        while j < last:
            methods += self._is(j, "fn")
            types += self._is(j, "type")
            j = self.pairs[j] + 1 if self.kinds[j] == "op" and self.texts[j] in OPEN else j + 1
        if info["visibility"] != "Private" or self.include_private:
            self._emit("Trait", name, info, last, Metrics(methods + types, 2 * methods + types), self._text(info["first"], body), generics)
        return last + 1

    def _impl(self, i: int, end: int, info: dict) -> int:
        generics, j = self._generics(i + 1)
        head, split = j, None
        while j < end and not self._is(j, "{"):
            if self._is(j, "for") and split is None and not self._is(j + 1, "<"):
                split = j
            if self._is(j, "where"):
                break
            j = self.pairs[j] + 1 if self.kinds[j] == "op" and self.texts[j] in OPEN else j + 1
        stop = j
        while j < end and not self._is(j, "{"):
            j += 1
        if j >= end:
            raise ParseError(f"line {self.lines[i]}: a body is missing")
        last = self.pairs[j]
        name = f"{self._text(head, split)} for {self._text(split + 1, stop)}" if split else f"impl {self._text(head, stop)}"
        methods, k = 0, j + 1
        while k < last:
            methods += self._is(k, "fn")
            k = self.pairs[k] + 1 if self.kinds[k] == "op" and self.texts[k] in OPEN else k + 1
        ident = self._emit("Impl", name, info | {"visibility": "Public", "scope": None}, last, Metrics(methods, methods), None, generics)
        if split:
            self._reference(ident, "TraitImplementation", self._text(head, split).split("<")[0], self.lines[head], info["module"])
        self.parents.append(ident)
        self._items(j + 1, last, info["module"])
        self.parents.pop()
        return last + 1

    def _mod(self, i: int, end: int, info: dict) -> int:
        name = self._name(i + 1)
        if self._is(i + 2, ";"):
            last = i + 2
        elif self._is(i + 2, "{"):
            last = self.pairs[i + 2]
        else:
            raise ParseError(f"line {self.lines[i]}: a body is missing")
        shown = info["visibility"] != "Private" or self.include_private
        if shown:
            self.parents.append(self._emit("Module", name, info, last, Metrics(1, 1)))
            self.elements[-1]["complexity"] = 1
        if last > i + 2:
            self._items(i + 3, last, f"{info['module']}::{name}")
        if shown:
            self.parents.pop()
        return last + 1

    def _use(self, i: int, end: int, info: dict) -> int:
        j = i + 1
        while j < end and not self._is(j, ";"):
            j = self.pairs[j] + 1 if self._is(j, "{") else j + 1
        if j >= end:
            raise ParseError(f"line {self.lines[i]}: a semicolon is missing")
        if not self.parents:
            self._use_tree(i + 1, j, "")
        return j + 1

    def _use_tree(self, a: int, b: int, prefix: str) -> None:
        brace = next((p for p in range(a, b) if self._is(p, "{")), None)
        if brace is not None:
            base = prefix + "".join(self.texts[a:brace])
            for x, y in self._parts(brace, self.pairs[brace]):
                self._use_tree(x, y, base)
            return
        words = self.texts[a:b]
        alias = None
        if "as" in words:
            at = words.index("as")
            alias, words = words[at + 1], words[:at]
        path = prefix + "".join(words)
        module, _, item = path.rpartition("::")
        self.imports.append({"module_path": module or item, "imported_items": [] if item == "*" or not module else [item], "is_glob": item == "*", "alias": alias})

    def _walk(self, a: int, b: int, m: Metrics) -> None:
        """Metrics of the body between braces ``a`` and ``b``."""
        kinds, texts, pairs = self.kinds, self.texts, self.pairs
        operators, operands = [], []
        depth, closers, pending, arms = 0, {}, [], {}
        cyclomatic = cognitive = returns = 0
        i = a
        while i <= b:
            x, kind = texts[i], kinds[i]
            if kind == "id":
                if x not in KEYWORDS or x == "self":
                    after = texts[i + 1]
                    if after == "!" and texts[i + 2] in OPEN and i + 2 <= b:
                        i = pairs[i + 2]
                    elif after not in AFTER_NAME and texts[i - 1] not in BEFORE_NAME:
                        operands.append(x)
                elif x in LOOPS:
                    if x != "for" or texts[i + 1] != "<":
                        cyclomatic += 1
                        cognitive += 1 + depth
                        operators.append(x)
                        pending.append(len(closers))
                elif x == "match":
                    cognitive += 1 + depth
                    operators.append("match")
                    j = i + 1
                    while texts[j] != "{":
                        j = pairs[j] + 1 if texts[j] in OPEN else j + 1
                    arms[j] = pairs[j]
                    depth += 1
                    m.nesting = max(m.nesting, depth)
                    closers[pairs[j]] = True
                    i = j
                elif x == "return":
                    returns += 1
                    operators.append("return")
                elif x == "break" or x == "continue":
                    cognitive += 1 + depth
                    operators.append(x)
                elif x == "let":
                    if texts[i - 1] not in ("if", "while", "&&"):
                        operators.append("let")
                elif texts[i + 1] == "!" and texts[i + 2] in OPEN and i + 2 <= b:
                    i = pairs[i + 2]
                elif x == "true" or x == "false":
                    operands.append(x)
            elif kind == "op":
                if x in WALKED:
                    before = texts[i - 1]
                    if x == "{":
                        header = bool(pending) and pending[-1] == len(closers)
                        if header:
                            pending.pop()
                        literal = i != a and not header and (kinds[i - 1] == "id" and before not in KEYWORDS or before == "Self")
                        if not literal:
                            depth += 1
                            m.nesting = max(m.nesting, depth)
                        closers[pairs[i]] = not literal
                    elif x == "}":
                        depth -= closers.pop(i, False)
                    elif x == "=>":
                        s = max((s for s, e in arms.items() if s < i < e), default=None)
                        if s is not None and not any(c < arms[s] for c in closers):
                            cyclomatic += 1
                    elif x == "?":
                        cyclomatic += 1
                        cognitive += 1 + depth
                        operators.append("try")
                    else:
                        kind = kinds[i - 1]
                        if kind == "num" or kind == "str" or kind == "char" or kind == "id" and before not in NO_OPERAND or before in (")", "]", "?"):
                            if x == "(":
                                if i != a and kind == "id":
                                    operators.append("method_call" if texts[i - 2] == "." else "call")
                            elif x == "&&" or x == "||":
                                cyclomatic += 1
                                operators.append(x)
                            else:
                                operators.append(x)
            elif kind == "num" or kind == "str" or kind == "char":
                operands.append(x)
            i += 1
        m.cyclomatic += cyclomatic
        m.cognitive += cognitive
        m.returns += returns
        m.operators.update(operators)
        m.operands.update(operands)

    def _body_references(self, a: int, b: int, ident: str, scope: str) -> None:
        kinds, texts, lines, names = self.kinds, self.texts, self.lines, self.names
        i, at = a + 1, bisect_left(names, a + 1)
        while at < len(names):
            start = names[at]
            at += 1
            if start < i:
                continue
            if start >= b:
                break
            i, method = start, texts[start - 1] == "."
            while texts[i + 1] == "::":
                if texts[i + 2] == "<":
                    i = self._skip_angle(i + 2) - 1
                elif i + 2 < b and kinds[i + 2] == "id":
                    i += 2
                else:
                    break
            text, after = texts[start] if i == start else self._text(start, i + 1), texts[i + 1]
            if after == "!" and i + 2 < b and texts[i + 2] in OPEN:
                self._reference(ident, "MacroInvocation", text, lines[start], scope)
                i = self.pairs[i + 2] + 1
                continue
            before = texts[start - 1]
            if after == "(":
                self._reference(ident, "FunctionCall", text, lines[start], scope)
            elif not method and start == i and text not in KEYWORDS and after != ":" and before not in ("let", "mut", "fn"):
                kind = "TypeUsage" if text[0].isupper() and before in (":", "->", "as", "<", "&") else "VariableAccess"
                self._reference(ident, kind, text, lines[start], scope)
            i += 1


def module_of(path: str) -> str:
    stem = path.rsplit("/", 1)[-1].removesuffix(".rs")
    return "crate" if stem in ("main", "lib") else f"crate::{stem}"


def line_counts(source: str) -> tuple[int, int]:
    """Code lines (not blank, no line comment) and line comments."""
    lines = [x.strip() for x in source.split("\n")]
    comments = sum(x.startswith("//") for x in lines)
    return sum(bool(x) for x in lines) - comments, comments
