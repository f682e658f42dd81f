r"""LaTeX documents as chunks: sentences, displays, captions, footnotes and bibliography entries, with file and lines.

A document is its files; they are gathered to a row, and read there by a small parser of our own, so that any number of
documents is read at once. A document that can't be read gives a row with its error.

The source stays as written, so inline mathematics, references and citations are part of a sentence; comments and labels
are left out, and the document's own macros are expanded. A paragraph is put together first, with the place in the source
of each part of it, and then cut at sentence ends (see text.sentence_ends) that stand in running text. Headings, list items,
displays and environments end a paragraph, as a blank line does. A footnote follows the sentence it is in.
"""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beliefmesh.functions import text as texts
from beliefmesh.operators.compiler import by_graph
from beliefmesh.sources.chunks import CHUNK

DEEPEST = 32
# fixed values: macros and environments by what the reader does with them
DEFINING = ("newcommand", "renewcommand", "providecommand")
INPUTS = ("input", "include")
CITES = ("cite", "citep", "citet", "citealp", "citealt", "citeauthor", "citeyear", "parencite", "textcite", "autocite", "nocite")
BREAKING = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph", "item", "par", "title", "author", "date", "maketitle", "appendix", "bibliographystyle", "newpage", "clearpage", "tableofcontents")
DROPPED = ("label", "newblock", "thanks")
DISPLAYS = tuple(name + star for name in ("equation", "align", "gather", "multline", "flalign", "alignat", "eqnarray", "displaymath") for star in ("", "*"))
FLOATS = ("figure", "figure*", "table", "table*")
SKIPPED = ("tabular", "tabular*", "tikzpicture", "verbatim", "lstlisting", "comment")
RAW = ("verbatim", "lstlisting", "comment")
#: Arguments of macros and environments: * a star, [ an optional and { a needed one.
ARGUMENTS = {
    **dict.fromkeys(DEFINING, "*{[[{"), **dict.fromkeys(INPUTS, "{"), **dict.fromkeys(CITES, "*[[{"), **dict.fromkeys(BREAKING[:7], "*[{"),
    **dict.fromkeys(("label", "ref", "eqref", "cref", "Cref", "thanks", "bibliography", "bibliographystyle", "date", "url", "emph", "textbf", "textit", "text", "mbox", "mathrm", "mathbf", "mathcal", "texttt", "textsc", "textrm", "underline", "hat", "bar", "tilde", "vec", "overline"), "{"),
    **dict.fromkeys(("footnote", "title", "author", "bibitem", "documentclass", "usepackage", "sqrt"), "[{"), **dict.fromkeys(("frac", "href", "setlength", "textcolor"), "{{"), **dict.fromkeys(("hspace", "vspace"), "*{"),
    "caption": "*[{", "item": "[", "includegraphics": "*[{",
}
OPENS = {"thebibliography": "{", "alignat": "{", "alignat*": "{", "tabular": "[{", "tabular*": "{[{", "figure": "[", "figure*": "[", "table": "[", "table*": "[", "minipage": "[{"}


class LatexError(ValueError):
    """A document that can't be read: a file is missing, or inputs itself."""


@dataclass
class Node:
    kind: str  # chars, comment, group, math, display, macro, environment
    start: int
    end: int
    name: str = ""
    args: list = field(default_factory=list)  # of a macro or environment: nodes, None where absent
    body: list = field(default_factory=list)
    inner: int = 0  # where the body of a group, math or environment begins


class Parser:
    """One file's source as a tree. Whatever is left open ends at the end."""

    def __init__(self, source: str, macros: dict[str, str]):
        self.s, self.macros, self.at = source, macros, 0

    def nodes(self, stop: str = "") -> list[Node]:
        """Nodes up to the string that ends the part, which is taken along."""
        out: list[Node] = []
        begin = self.at
        while self.at < len(self.s):
            here = self.at
            if stop and self.s.startswith(stop, here):
                self.chars(out, begin, here)
                self.at = here + len(stop)
                return out
            if self.s[here] not in "\\{%$":
                self.at += 1
                continue
            self.chars(out, begin, here)
            out.append(self.special(here))
            begin = self.at
        self.chars(out, begin, len(self.s))
        return out

    def chars(self, out: list[Node], a: int, b: int) -> None:
        if a < b:
            out.append(Node("chars", a, b))

    def special(self, here: int) -> Node:
        s = self.s
        if s[here] == "%":
            end = s.find("\n", here)
            self.at = len(s) if end < 0 else end + 1
            while self.at < len(s) and s[self.at] in " \t":
                self.at += 1
            return Node("comment", here, self.at)
        for opening, closing, kind in (("{", "}", "group"), ("$$", "$$", "display"), ("$", "$", "math"), ("\\[", "\\]", "display"), ("\\(", "\\)", "math")):
            if s.startswith(opening, here):
                self.at = inner = here + len(opening)
                body = self.nodes(closing)
                return Node(kind, here, self.at, opening, body=body, inner=inner)
        word = re.compile(r"\\(?:[A-Za-z@]+|.|$)", re.S).match(s, here)
        name, self.at = word[0][1:], word.end()
        if name == "begin":
            return self.environment(here)
        args = self.arguments(self.macros.get(name, ""))
        return Node("macro", here, self.at, name, args)

    def environment(self, here: int) -> Node:
        named = re.compile(r"\s*\{([^{}]*)\}").match(self.s, self.at)
        if not named:
            return Node("macro", here, self.at, "begin")
        name, self.at = named[1].strip(), named.end()
        closing = f"\\end{{{named[1]}}}"
        if name in RAW:
            inner, end = self.at, self.s.find(closing, self.at)
            self.at = len(self.s) if end < 0 else end + len(closing)
            return Node("environment", here, self.at, name, inner=inner)
        args = self.arguments(OPENS.get(name, ""))
        inner = self.at
        body = self.nodes(closing)
        return Node("environment", here, self.at, name, args, body, inner)

    def arguments(self, spec: str) -> list[Node | None]:
        out: list[Node | None] = []
        for what in spec:
            here = self.at
            while self.at < len(self.s) and self.s[self.at].isspace() and not re.match(r"[ \t]*\n[ \t]*\n", self.s[self.at :  self.at + 200]):
                self.at += 1
            at = self.at
            if at < len(self.s) and what == "*" and self.s[at] == "*":
                self.at += 1
                out.append(Node("chars", at, at + 1))
            elif at < len(self.s) and what == "[" and self.s[at] == "[":
                self.at += 1
                body = self.nodes("]")
                out.append(Node("group", at, self.at, "[", body=body, inner=at + 1))
            elif at < len(self.s) and what == "{" and self.s[at] not in "}%" and not self.s.startswith("\\end{", at):
                if self.s[at] in "\\{":
                    out.append(self.special(at))
                else:
                    self.at += 1
                    out.append(Node("chars", at, at + 1))
            else:
                self.at = here
                out.append(None)
        return out


CLOSING = {"{": "}", "[": "]", "$": "$", "$$": "$$", "\\(": "\\)", "\\[": "\\]"}
DEF = re.compile(r"\\def\s*\\([A-Za-z@]+)\s*((?:#\d\s*)*)(?=\{)")


@dataclass
class Definition:
    count: int
    default: str | None
    body: str


@dataclass
class Part:
    """A stretch of a paragraph: its text, where it comes from, whether sentences may end in it, and what goes with it."""

    text: str
    start: int
    end: int
    running: bool
    cites: list[str] = field(default_factory=list)
    after: list[dict] = field(default_factory=list)  # footnotes


class Source:
    def __init__(self, name: str, s: str):
        self.name, self.s = name, s
        self.lines = [0, *(i + 1 for i, c in enumerate(s) if c == "\n")]

    def locator(self, a: int, b: int) -> str:
        """The lines from the first to the last visible character."""
        while b > a + 1 and self.s[b - 1].isspace():
            b -= 1
        while a < b - 1 and self.s[a].isspace():
            a += 1
        return f"file={self.name};lines={bisect_right(self.lines, a)}-{bisect_right(self.lines, max(a, b - 1))}"


class Reader:
    def __init__(self, files: dict[str, str], main: str):
        self.files, self.main, self.root = files, main, posixpath.dirname(main)
        self.macros = dict(ARGUMENTS)
        self.defined: dict[str, Definition] = {}
        self.out: list[dict] = []
        self.parts: list[Part] = []
        self.open: list[str] = []
        self.src = Source("", "")

    def parse(self, s: str) -> list[Node]:
        return Parser(s, self.macros).nodes()

    def enter(self, path: str) -> None:
        if path not in self.files:
            raise LatexError(f"no file {path}")
        if path in self.open:
            raise LatexError(f"{' -> '.join([*self.open, path])} inputs itself")
        self.open.append(path)

    def resolve(self, name: str) -> str:
        path = posixpath.normpath(posixpath.join(self.root, name.strip()))
        for p in (path, path + ".tex"):
            if p in self.files and (p.endswith(".tex") or p == path):
                return p
        raise LatexError(f"input {name.strip()} names no file")

    # definitions

    def define(self, path: str) -> None:
        """The macros that a file and those it inputs define, in reading order; arguments of each are known afterwards."""
        self.enter(path)
        s = self.files[path]
        nodes = self.parse(s)
        plain = list(s)
        for n in walk(nodes):
            if n.kind == "comment":
                plain[n.start : n.end] = " " * (n.end - n.start)
        clear = "".join(plain)
        for m in DEF.finditer(clear):
            group = Parser(clear, {})
            body = group.special(m.end()) if clear[m.end() : m.end() + 1] == "{" else None
            if body is not None:
                self.add(m[1], Definition(len(re.findall(r"#\d", m[2])), None, clear[body.inner : body.end - 1]))
        for n in walk(nodes):
            if n.kind != "macro":
                continue
            if n.name in DEFINING and n.args and n.args[1] is not None and n.args[4] is not None:
                name = inside(s, n.args[1]).strip().lstrip("\\")
                if n.name != "providecommand" or name not in self.defined:
                    count = inside(s, n.args[2]) if n.args[2] else "0"
                    self.add(name, Definition(int(count) if count.strip().isdigit() else 0, inside(s, n.args[3]) if n.args[3] else None, inside(s, n.args[4])))
            elif n.name in INPUTS and n.args and n.args[0] is not None:
                self.define(self.resolve(inside(s, n.args[0])))
        self.open.pop()

    def add(self, name: str, d: Definition) -> None:
        self.defined[name] = d
        self.macros[name] = "[" * (d.default is not None) + "{" * (d.count - (d.default is not None))

    # text of nodes

    def render(self, s: str, nodes: list[Node | None], cites: list[str], labels: list[str], notes: list[dict] | None, depth: int = 0) -> str:
        """Source of nodes with own macros expanded, without comments, labels and footnotes, which are collected."""
        out = []
        for n in nodes:
            if n is None or n.kind == "comment":
                continue
            if n.kind == "chars":
                out.append(s[n.start : n.end])
            elif n.kind == "macro":
                out.append(self.macro_text(s, n, cites, labels, notes, depth))
            else:
                body = self.render(s, n.body, cites, labels, notes, depth)
                closing = f"\\end{{{n.name}}}" if n.kind == "environment" else CLOSING[n.name]
                out.append(s[n.start : n.inner] + body + (closing if s.endswith(closing, n.inner, n.end) else ""))
        return "".join(out)

    def macro_text(self, s: str, n: Node, cites: list[str], labels: list[str], notes: list[dict] | None, depth: int) -> str:
        last = next((a for a in reversed(n.args) if a is not None), None)
        if n.name == "label" and last is not None:
            labels.append(inside(s, last).strip())
            return ""
        if n.name == "footnote":
            if notes is not None and last is not None:
                own: list[str] = []
                words = texts.normalise(self.render(s, last.body or [last], own, [], notes, depth))
                notes.append({"unit": "footnote", "text": words, "cites": own, "node": n})
            return ""
        if n.name in DROPPED:
            return ""
        if n.name in CITES and last is not None:
            keys = [k.strip() for k in inside(s, last).split(",")]
            cites += [k for i, k in enumerate(keys) if k and k not in cites and k not in keys[:i]]
        own = self.defined.get(n.name)
        if own is not None and depth < DEEPEST:
            values = []
            for i, a in enumerate(n.args):
                absent = own.default if i == 0 and own.default is not None else ""
                values.append(absent if a is None else self.render(s, a.body if a.kind == "group" else [a], cites, labels, notes, depth))
            body = re.sub(r"#(\d)", lambda m: values[int(m[1]) - 1] if 0 < int(m[1]) <= len(values) else m[0], own.body)
            return self.render(body, self.parse(body), cites, labels, notes, depth + 1)
        out, at = [], n.start
        for a in n.args:
            if a is not None:
                out += [s[at : a.start], self.render(s, [a], cites, labels, notes, depth)]
                at = a.end
        return "".join(out) + s[at : n.end]

    # prose

    def chunk(self, unit: str, words: str, a: int, b: int, cites=(), labels=(), key=None) -> None:
        words = texts.normalise(words)
        if words:
            self.out.append({"unit": unit, "text": words, "locator": self.src.locator(a, b), "cites": list(cites), "labels": list(labels), "key": key})

    def finish(self) -> None:
        """Cut the paragraph into sentences."""
        parts, self.parts = self.parts, []
        whole = "".join(p.text for p in parts)
        starts = [0]
        for p in parts:
            starts.append(starts[-1] + len(p.text))
        cuts, begin = [], 0
        for m in re.finditer(r"[.?!]['\")\]]*(\s+|$)", whole):
            own = parts[bisect_right(starts, m.start()) - 1]  # of parts that begin there, the one that has text
            if own.running and (m.end() == len(whole) or texts.sentence_ends(whole[begin : m.start()], whole[m.end() :], latex=True)):
                cuts.append((begin, m.start(1), m.end()))
                begin = m.end()
        if begin < len(whole) or not cuts:
            cuts.append((begin, len(whole), len(whole)))
        for i, (a, b, following) in enumerate(cuts):
            last = i == len(cuts) - 1
            own = [(k, p) for k, p in enumerate(parts) if starts[k] < following and starts[k + 1] > a or starts[k] == starts[k + 1] and (a <= starts[k] < following or last and starts[k] == following)]
            spans = []
            for k, p in own:
                low, high = max(a, starts[k]), min(b, starts[k + 1])
                if low < high and whole[low:high].strip():
                    spans.append((p.start + low - starts[k], p.start + high - starts[k]) if p.running else (p.start, p.end))
            words = whole[a:b]
            if spans and any(c.isalnum() for c in words):
                cites = list(dict.fromkeys(c for k, p in own if starts[k] < b or starts[k] == starts[k + 1] for c in p.cites))
                self.chunk("sentence", words, spans[0][0], spans[-1][1], cites)
            for _, p in own:
                self.out += p.after
                p.after = []
        self.out += [x for p in parts for x in p.after]

    def prose(self, nodes: list[Node]) -> None:
        s, skipping, commented = self.src.s, "", False
        for n in nodes:
            if skipping:  # the name, parameters and body of a \def
                skipping = "" if skipping == "body" and n.kind == "group" else "body"
                continue
            after_comment, commented = commented, n.kind == "comment" and "\n" in s[n.start : n.end]
            if n.kind == "chars":
                self.running(n, after_comment)
            elif n.kind == "display":
                self.display(n)
            elif n.kind == "environment":
                self.environment(n)
            elif n.kind == "macro" and n.name == "def":
                skipping = "name"
            elif n.kind == "macro" and (n.name in DEFINING or n.name in DROPPED):
                pass
            elif n.kind == "macro" and n.name in INPUTS and n.args and n.args[0] is not None:
                self.read(self.resolve(inside(s, n.args[0])))
            elif n.kind == "macro" and n.name == "bibliography":
                self.finish()
                self.entries_file(self.main.rpartition(".")[0] + ".bbl")
            elif n.kind == "macro" and n.name in BREAKING:
                self.finish()
            elif n.kind != "comment":
                cites: list[str] = []
                notes: list[dict] = []
                words = self.render(s, [n], cites, [], notes)
                self.parts.append(Part(words, n.start, n.end, False, cites, [self.note(x, n) for x in notes if x["text"]]))

    def note(self, x: dict, n: Node) -> dict:
        at = x["node"] if x["node"] is n or n.start <= x["node"].start < x["node"].end <= n.end and self.src.s.startswith("\\footnote", x["node"].start) else n
        return {"unit": "footnote", "text": x["text"], "locator": self.src.locator(at.start, at.end), "cites": x["cites"], "labels": [], "key": None}

    def running(self, n: Node, after_comment: bool) -> None:
        s, a = self.src.s, n.start
        blank = re.compile(r"[ \t]*\n").match(s, a, n.end) if after_comment else None
        if blank:
            self.finish()
            a = blank.end()
        for m in re.compile(r"\n[ \t]*\n\s*").finditer(s, a, n.end):
            self.parts.append(Part(s[a : m.start()], a, m.start(), True))
            self.finish()
            a = m.end()
        if a < n.end:
            self.parts.append(Part(s[a : n.end], a, n.end, True))

    def display(self, n: Node) -> None:
        self.finish()
        cites: list[str] = []
        labels: list[str] = []
        notes: list[dict] = []
        words = self.render(self.src.s, [n], cites, labels, notes)
        self.chunk("equation", words, n.start, n.end, cites, labels)
        self.out += [self.note(x, n) for x in notes if x["text"]]

    def environment(self, n: Node) -> None:
        if n.name in DISPLAYS:
            self.display(n)
            return
        self.finish()
        if n.name in FLOATS:
            for c in walk(n.body):
                if c.kind == "macro" and c.name == "caption" and c.args and c.args[-1] is not None:
                    cites: list[str] = []
                    notes: list[dict] = []
                    words = self.render(self.src.s, c.args[-1].body, cites, [], notes)
                    self.chunk("caption", words, c.start, c.end, cites)
                    self.out += [self.note(x, c) for x in notes if x["text"]]
        elif n.name == "thebibliography":
            self.entries(n.body)
        elif n.name not in SKIPPED:
            self.prose(n.body)
            self.finish()

    def entries(self, nodes: list[Node]) -> None:
        marks = [i for i, n in enumerate(nodes) if n.kind == "macro" and n.name == "bibitem" and n.args and n.args[-1] is not None]
        for i, j in zip(marks, [*marks[1:], len(nodes)], strict=True):
            own = nodes[i + 1 : j]
            words = self.render(self.src.s, own, [], [], [])
            if own:
                self.chunk("reference", words, nodes[i].start, own[-1].end, key=inside(self.src.s, nodes[i].args[-1]).strip())

    def entries_file(self, path: str) -> None:
        if path in self.files:
            saved, self.src = self.src, Source(self.relative(path), self.files[path])
            for n in walk(self.parse(self.src.s)):
                if n.kind == "environment" and n.name == "thebibliography":
                    self.entries(n.body)
            self.src = saved

    def relative(self, path: str) -> str:
        return posixpath.relpath(path, self.root) if self.root else path

    def read(self, path: str) -> None:
        self.enter(path)
        self.finish()
        saved, self.src = self.src, Source(self.relative(path), self.files[path])
        nodes = self.parse(self.src.s)
        if path == self.main:
            nodes = next((n.body for n in nodes if n.kind == "environment" and n.name == "document"), nodes)
        self.prose(nodes)
        self.finish()
        self.src = saved
        self.open.pop()


def walk(nodes: list[Node | None]) -> Iterator[Node]:
    for n in nodes:
        if n is not None:
            yield n
            yield from walk(n.args)
            yield from walk(n.body)


def inside(s: str, n: Node) -> str:
    """Source of an argument without its braces."""
    return s[n.inner : n.end - 1] if n.kind == "group" else s[n.start : n.end]


def read_files(files: dict[str, str], main: str) -> list[dict]:
    """The chunks of a document, in its order."""
    reader = Reader(files, main)
    try:
        reader.define(main)
        reader.read(main)
    except RecursionError:
        raise LatexError("groups are nested too deeply") from None
    return [{**c, "ord": i} for i, c in enumerate(reader.out)]


def main_of(files: dict[str, str]) -> str:
    """The file that holds the document environment; the shallowest and first by name, of several."""
    holding = [p for p, s in files.items() if p.endswith(".tex") and re.search(r"(?m)^[^%\n]*\\begin\s*\{document\}", s)]
    if not holding:
        raise LatexError("no file holds a document")
    return min(holding, key=lambda p: (p.count("/"), p))


def read_latex(files: DataFrame, mains: DataFrame | None = None) -> DataFrame:
    """document, the fields of CHUNK, and error of files(document, path, text), paths being relative to the document's
    folder. mains: document, main; by default the file that holds the document environment. A document's files are one row;
    a null text is an empty file."""
    rows = files.groupBy(F.col("document").alias("graph_id")).agg(F.collect_list(F.struct("path", F.coalesce("text", F.lit("")).alias("text"))).alias("files"))
    if mains is not None:
        rows = rows.join(mains.select(F.col("document").alias("graph_id"), "main"), "graph_id", "left")

    def run(row: dict) -> list[dict]:
        own = {posixpath.normpath(x["path"]): x["text"] for x in row["files"]}
        try:
            return [{**c, "error": None} for c in read_files(own, row.get("main") or main_of(own))]
        except LatexError as e:
            return [{"ord": 0, "error": str(e)}]

    return by_graph(rows, lambda batch: map(run, batch), f"{CHUNK}, error string").withColumnRenamed("graph_id", "document")


def latex_files(spark: SparkSession, folder: str) -> DataFrame:
    """files for read_latex: the .tex and .bbl files below folder, whose direct subfolders are the documents."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tex,bbl}").text(folder, wholetext=True)
    tail = F.regexp_extract(F.col("_metadata.file_path"), r"/" + re.escape(folder.rstrip("/").rpartition("/")[2]) + r"/([^/]+)/(.*)$", 0)
    cut = lambda i: F.regexp_extract(tail, r"^/[^/]+/([^/]+)/(.*)$", i)
    return found.select(cut(1).alias("document"), cut(2).alias("path"), F.col("value").alias("text"))
