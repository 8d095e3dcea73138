"""Go declarations, symbols and calls from a small scanner of our own.

The scanner knows tokens, brackets and the end of a statement; it reads
declarations at package level and calls inside function bodies, and takes types
as they are written.  A text with unbalanced brackets or without a package
clause counts as not parsed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corvane.functions import stem, text as tx
from corvane.operators.chunking import greedy_spans

_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+')|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<line>\n)|(?P<space>[ \t\r]+)|(?P<mark><-|\.\.\.|:=|&&|\|\||\+\+|--|[<>=!+\-*/%&|^]=|<<|>>|.)",
    re.S,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDS = {"break", "continue", "fallthrough", "return"}


@dataclass
class Token:
    kind: str
    text: str
    line: int
    end_line: int
    match: int = -1  # the index of the bracket on the other side


@dataclass
class Unit:
    """One declaration."""

    type: str
    name: str
    start_line: int
    end_line: int
    signature: str = ""
    doc: str = ""
    content: str = ""
    children: list[dict] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    calls: list[str] = field(default_factory=list)
    receiver: str = ""


class NotGo(ValueError):
    """The text can't be read as Go."""


def tokens(text: str) -> tuple[list[Token], dict[int, tuple[int, str]]]:
    """Tokens with statement ends (kind ';'), and comments by their last line (first line, text)."""
    out, comments, line, opened = [], {}, 1, []

    def end_statement():
        last = out[-1] if out else None
        if last and (last.kind in ("string", "number") or (last.kind == "word" and (last.text not in _KEYWORDS or last.text in _ENDS)) or last.text in (")", "]", "}", "++", "--")):
            out.append(Token(";", ";", line, line))

    for m in _TOKEN.finditer(text):
        kind, part = m.lastgroup, m[0]
        stop = line + part.count("\n")
        if kind == "comment":
            comments[stop] = (line, part)
            if stop > line:
                end_statement()
        elif kind == "line":
            end_statement()
        elif kind != "space":
            token = Token(";" if part == ";" else kind, part, line, stop)
            if part in _OPEN and kind == "mark":
                opened.append(len(out))
            elif part in _CLOSE and kind == "mark":
                if not opened or _OPEN[out[opened[-1]].text] != part:
                    raise NotGo("unbalanced brackets")
                token.match = opened.pop()
                out[token.match].match = len(out)
            out.append(token)
        line = stop
    if opened:
        raise NotGo("unbalanced brackets")
    end_statement()
    return out, comments


class File:
    """The declarations of one source text."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.t, self.comments = tokens(text)
        self.text = text
        if not self.t or self.t[0].text != "package":
            raise NotGo("no package clause")
        self.units: list[Unit] = []
        self.symbols: list[tuple[str, str, int, str]] = []  # name, type, line, signature
        self.calls: list[tuple[str, int, str, int]] = []  # caller, its line, callee, line
        i = self._statement(0)
        while i < len(self.t):
            word = self.t[i].text
            if word == "func":
                i = self._func(i)
            elif word in ("type", "const", "var", "import"):
                i = self._group(i, word)
            elif self.t[i].kind == ";":
                i += 1
            else:
                raise NotGo(f"unexpected {word!r}")

    # -- helpers

    def _statement(self, i: int) -> int:
        """The index after the statement that starts at i."""
        while i < len(self.t) and self.t[i].kind != ";":
            i = self.t[i].match + 1 if self.t[i].text in _OPEN and self.t[i].kind == "mark" else i + 1
        return i + 1

    def _source(self, a: int, b: int) -> str:
        """Tokens a..b as they would be written on one line."""
        out = ""
        for k in range(a, b):
            t, before = self.t[k], self.t[k - 1] if k > a else None
            if before and ((before.kind in ("word", "number", "string") and (t.kind in ("word", "number", "string") or t.text in ("*", "{", "<-") or (t.text == "[" and before.text not in ("map", "chan") and k == a + 1))) or before.text in (",", ")", "=", ":=") and t.text not in (",", ")", ".", "]")):
                out += " "
            out += "; " if t.kind == ";" else t.text
        return out

    def _doc(self, line: int) -> str:
        """The text of the comments that end on the line before."""
        found = []
        while (line - 1) in self.comments:
            first, text = self.comments[line - 1]
            if not self.lines[first - 1].lstrip().startswith(("//", "/*")):
                break
            found.insert(0, text)
            line = first
        rows = []
        for c in found:
            rows += [c[2:].removeprefix(" ").rstrip()] if c.startswith("//") else [r.rstrip() for r in c[2:-2].strip().split("\n")]
        return "\n".join(rows).strip("\n") + "\n" if any(rows) else ""

    def _fields(self, a: int, b: int) -> list[tuple[list[str], int, int]]:
        """Names and type (token range) of each field of a parameter list between a and b."""
        parts, i, start = [], a, a
        while i <= b:
            if i == b or self.t[i].text == "," or self.t[i].kind == ";":
                if i > start:
                    parts.append((start, i))
                start = i + 1
            elif self.t[i].text in _OPEN and self.t[i].kind == "mark":
                i = self.t[i].match
            i += 1
        named = any(e - s > 1 and self.t[s].kind == "word" and self.t[s].text not in _KEYWORDS and self.t[s + 1].text != "." and not (self.t[s + 1].text == "[" and self.t[s + 1].match == e - 1 and self.t[s + 1].match > s + 2) for s, e in parts)
        if not named:
            return [([], s, e) for s, e in parts]
        out, waiting = [], []
        for s, e in parts:
            waiting.append(self.t[s].text)
            if e - s > 1:
                out.append((waiting, s + 1, e))
                waiting = []
        return out

    def _listed(self, fields) -> str:
        return ", ".join((", ".join(n) + " " if n else "") + self._source(s, e) for n, s, e in fields)

    def _short(self, a: int, b: int) -> str:
        """A type as symbols show it."""
        t = self.t
        if b <= a:
            return ""
        first = t[a].text
        if first == "*":
            return "*" + self._short(a + 1, b)
        if first == "[":
            return ("[]" if t[a].match == a + 1 else "[...]") + self._short(t[a].match + 1, b)
        if first == "map":
            return f"map[{self._short(a + 2, t[a + 1].match)}]{self._short(t[a + 1].match + 1, b)}"
        if first == "chan":
            return "chan " + self._short(a + 1, b)
        if first == "func":
            return "func(...)"
        if first in ("interface", "struct", "...") or t[a].kind != "word":
            return "interface{}"
        return self._source(a, b) if all(x.kind == "word" or x.text == "." for x in t[a:b]) else "interface{}"

    # -- declarations

    def _func(self, i: int) -> int:
        t, start, k = self.t, i, i + 1
        receiver = shown = ""
        if t[k].text == "(":
            fields = self._fields(k + 1, t[k].match)
            shown = f"({self._listed(fields)}) "
            _, s, e = fields[0]
            star = "*" if t[s].text == "*" else ""
            receiver = self._source(s, e) if e - s == 1 + bool(star) else ""
            k = t[k].match + 1
        name = t[k].text
        k += 1
        if t[k].text == "[":
            k = t[k].match + 1
        params = self._fields(k + 1, t[k].match)
        k = t[k].match + 1
        results, after = [], k
        if k < len(t) and t[k].text == "(":
            results, after = self._fields(k + 1, t[k].match), t[k].match + 1
        else:
            while after < len(t) and t[after].kind != ";" and not (t[after].text == "{" and t[after - 1].text not in ("interface", "struct")):
                after = t[after].match + 1 if t[after].text in _OPEN and t[after].kind == "mark" else after + 1
            if after > k:
                results = [([], k, after)]
        body = (after, t[after].match) if after < len(t) and t[after].text == "{" else None
        last = t[body[1]] if body else t[after - 1]
        sig = f"func {shown}{name}({self._listed(params)})"
        if results:
            many = len(results) > 1 or bool(results[0][0])
            sig += f" ({self._listed(results)})" if many else f" {self._listed(results)}"
        unit = Unit("method" if shown else "function", name, t[start].line, last.end_line, sig, self._doc(t[start].line), receiver=receiver)
        unit.content = "\n".join(self.lines[unit.start_line - 1 : unit.end_line])
        full = f"{receiver}.{name}" if shown else name
        if body:
            unit.calls = list(dict.fromkeys(c for c, _ in self._calls(*body, inner=True)))
            self.calls += [(full, t[start].line, c, n) for c, n in self._calls(*body, inner=False)]
        self.units.append(unit)
        plist = ", ".join(f"{n} {self._short(s, e)}" for ns, s, e in params for n in ns or [""]).replace("  ", " ")
        plist = ", ".join(x.strip() for x in plist.split(", ")) if params else ""
        rlist = ", ".join(self._short(s, e) for _, s, e in results)
        shown_sig = f"func {f'({receiver}) ' if receiver else ''}{name}({plist})" + (f" ({rlist})" if len(results) > 1 else f" {rlist}" if results else "")
        self.symbols.append((full, unit.type, t[start].line, shown_sig))
        if body:
            self._local(*body)
        return self._statement(body[1] if body else after)

    def _local(self, a: int, b: int) -> None:
        """Symbols that var, const and type declare inside a body."""
        i = a + 1
        while i < b:
            if self.t[i].text in ("var", "const", "type") and self.t[i].kind == "word" and (self.t[i - 1].kind == ";" or self.t[i - 1].text in "{:"):
                self._specs(i, self.t[i].text, False)
            i += 1

    def _calls(self, a: int, b: int, inner: bool) -> list[tuple[str, int]]:
        """Callee and line of the calls in a body; without those in function literals unless ``inner``."""
        t, out, i = self.t, [], a + 1
        while i < b:
            if t[i].text == "func" and t[i].kind == "word":
                k = i + 1
                while k < b and t[k].text != "{" and t[k].kind != ";" and t[k].text not in (",", ")"):
                    k = t[k].match + 1 if t[k].text in "([" and t[k].kind == "mark" else k + 1
                if k < b and t[k].text == "{" and not inner:
                    i = t[k].match + 1
                    continue
                i = k if k < b and t[k].text == "{" else i + 1
                continue
            if t[i].text == "(" and t[i].kind == "mark" and t[i - 1].kind == "word" and t[i - 1].text not in _KEYWORDS:
                name, line = t[i - 1].text, t[i - 1].line
                if t[i - 2].text == ".":
                    before = t[i - 3]
                    simple = before.kind == "word" and before.text not in _KEYWORDS and t[i - 4].text != "."
                    name, line = (f"{before.text}.{name}", before.line) if simple else (name, line)
                out.append((name, line))
            i += 1
        return out

    def _specs(self, i: int, word: str, top: bool) -> int:
        """One declaration, with or without brackets; returns the index after it."""
        t, k = self.t, i + 1
        grouped = t[k].text == "("
        stop = t[k].match if grouped else self._statement(k) - 1
        k += grouped
        first, last = t[i].line, t[stop if grouped else stop - 1].end_line
        names, paths = [], []
        while k < stop:
            end = min(self._statement(k) - 1, stop)
            if t[k].kind == ";":
                k += 1
                continue
            if word == "import":
                paths.append(t[end - 1].text.strip('"'))
            elif word == "type":
                self._type(k, end, first, last, grouped, top)
            else:
                j = k
                while True:
                    names.append(t[j].text)
                    if t[j].text != "_":
                        self.symbols.append((t[j].text, "variable", t[j].line, ""))
                    if j + 1 < end and t[j + 1].text == ",":
                        j += 2
                        continue
                    break
            k = end + 1
        if top and word in ("const", "var", "import"):
            unit = Unit(word, ", ".join(names) if word != "import" else "imports", first, last, doc="" if word == "import" else self._doc(first), imports=paths)
            unit.content = "\n".join(self.lines[first - 1 : last])
            self.units.append(unit)
        return self._statement(stop)

    def _group(self, i: int, word: str) -> int:
        return self._specs(i, word, True)

    def _type(self, k: int, end: int, first: int, last: int, grouped: bool, top: bool) -> None:
        t, name = self.t, self.t[k].text
        j = k + 1
        if t[j].text == "[" and t[j].match > j + 1 and t[t[j].match + 1].kind != ";" and t[j + 1].kind == "word" and t[j + 2].kind == "word":
            j = t[j].match + 1  # type parameters
        if t[j].text == "=":
            j += 1
        kind = t[j].text if t[j].text in ("struct", "interface") else "type"
        self.symbols.append((name, kind, t[k].line, f"{kind} {name}"))
        if not top:
            return
        a, b = (t[k].line, t[end - 1].end_line) if grouped else (first, last)
        doc = self._doc(t[k].line) if grouped else ""
        unit = Unit(kind, name, a, b, f"type {name} " + (kind if kind != "type" else self._source(j, end)), doc or self._doc(first))
        unit.content = "\n".join(self.lines[a - 1 : b])
        if kind != "type":
            x, stop = j + 2, t[j + 1].match
            while x < stop:
                e = min(self._statement(x) - 1, stop)
                if t[x].kind != ";":
                    unit.children.append(self._member(x, e, kind))
                x = e + 1
        self.units.append(unit)

    def _member(self, x: int, e: int, kind: str) -> dict:
        t = self.t
        if kind == "interface":
            if e > x + 1 and t[x + 1].text == "(":
                params, rest = self._fields(x + 2, t[x + 1].match), t[x + 1].match + 1
                sig = f"func {t[x].text}({self._listed(params)})"
                if rest < e:
                    results = self._fields(rest + 1, t[rest].match) if t[rest].text == "(" else [([], rest, e)]
                    sig += f" {self._listed(results)}"
                return {"type": "method", "name": t[x].text, "signature": sig}
            return {"type": "embedded", "name": self._source(x, e), "signature": ""}
        if t[e - 1].kind == "string":
            e -= 1  # the tag
        names, j = [t[x].text], x
        while j + 2 < e and t[j + 1].text == ",":
            j += 2
            names.append(t[j].text)
        if j + 1 >= e or t[x].text == "*" or t[x + 1].text == ".":
            return {"type": "field", "name": self._source(x, e), "signature": ""}
        return {"type": "field", "name": ", ".join(names), "signature": ""}


def parse(text: str | None) -> File | None:
    try:
        return File(text or "")
    except (NotGo, IndexError):
        return None


def _of(text: str | None, what: str) -> list:
    """Units, symbols or calls of a text; none if it can't be read."""
    found = parse(text)
    return getattr(found, what) if found else []


# --- passages -----------------------------------------------------------------------


def _count(text: str) -> int:
    return len(re.findall(r"\w+", text)) * 13 // 10


def split_unit(unit: Unit, most: int, overlap: int) -> list[dict]:
    """A declaration as one passage, or as several under its signature if it is too large."""
    whole = {"type": unit.type, "name": unit.name, "id_line": unit.start_line, "suffix": "", "start_line": unit.start_line, "end_line": unit.end_line, "content": unit.content, "text": f"// {unit.doc}\n{unit.content}" if unit.doc and len(unit.doc.encode()) < 500 else unit.content}
    if _count(unit.content) <= most:
        return [whole]
    header = unit.signature + (" {" if unit.signature and unit.type in ("function", "method", "struct", "interface") else "")
    lines = unit.content.split("\n")
    if lines[-1] == "":
        lines.pop()
    skip = next((i + 1 for i, line in enumerate(lines) if "{" in line), 0) if unit.signature else 0
    body = lines[skip:]
    if not body:
        return [whole]
    out = []
    for n, (a, b) in enumerate(greedy_spans([_count(x) for x in body], max(50, most - _count(header) - 10), overlap, closed=False)):
        tail = "// ... continued" if b < len(body) else "}" if unit.type in ("function", "method") else ""
        text = (header + "\n" if header else "") + "".join(x + "\n" for x in body[a:b]) + tail
        line = unit.start_line + skip + a
        out.append({"type": unit.type, "name": unit.name, "id_line": line, "suffix": f"_{n}", "start_line": line, "end_line": min(unit.start_line + skip + b - 1, unit.end_line), "content": text, "text": text})
    return out


_PASSAGES = "array<struct<type:string,name:string,id_line:int,suffix:string,start_line:int,end_line:int,content:string,text:string>>"


def unit_chunks(docs: DataFrame, most: int = 512, overlap: int = 50, stemming: bool = False) -> DataFrame:
    """Passages of Go documents by declaration; documents without any give none."""

    @F.pandas_udf(_PASSAGES)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[p for u in _of(t, "units") for p in split_unit(u, most, overlap)] for t in texts])

    kept = [c for c in ("num", "path", "mod_time", "lang") if c in docs.columns]
    rows = docs.select("doc_id", *kept, F.explode(run("text")).alias("u"))
    tokens_ = tx.tokenize("u.content")
    return rows.select(
        F.concat(tx.unit_chunk_id("doc_id", "u.type", "u.name", "u.id_line"), F.col("u.suffix")).alias("chunk_id"), "doc_id", *kept, "u.start_line", "u.end_line", "u.text", (stem.stem_tokens(tokens_) if stemming else tokens_).alias("tokens")
    )


_UNITS = "array<struct<type:string,name:string,signature:string,start_line:int,end_line:int,doc:string,children:array<struct<type:string,name:string,signature:string>>,imports:array<string>,calls:array<string>>>"


def _parsed(docs: DataFrame, what: str, keys: tuple[str, ...], kind: str) -> DataFrame:
    """doc_id and one row for each unit, symbol or call of the Go documents."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        row = lambda x: {k: getattr(x, k) for k in keys} if isinstance(x, Unit) else dict(zip(keys, x))
        return pd.Series([[row(x) for x in _of(t, what)] for t in texts])

    return docs.where("lang = 'go'").select("doc_id", F.inline(run("text")))


def units(docs: DataFrame) -> DataFrame:
    """doc_id and the declarations of each Go document."""
    return _parsed(docs, "units", ("type", "name", "signature", "start_line", "end_line", "doc", "children", "imports", "calls"), _UNITS)


def symbols(docs: DataFrame) -> DataFrame:
    """id, name, type, doc_id, line and signature of the symbols of Go documents."""
    rows = _parsed(docs, "symbols", ("name", "type", "line", "signature"), "array<struct<name:string,type:string,line:int,signature:string>>")
    return rows.select(tx.symbol_id("doc_id", "name", "line").alias("id"), "name", "type", "doc_id", "line", "signature")


def calls(docs: DataFrame) -> DataFrame:
    """Raw calls: doc_id, caller, caller_line, callee, line."""
    return _parsed(docs, "calls", ("caller", "caller_line", "callee", "line"), "array<struct<caller:string,caller_line:int,callee:string,line:int>>")
