"""HTML, Markdown, wiki and LaTeX leftovers to clean text, by tag-path ratios.

Markup of the four kinds is read as one tree: a heading of any syntax is a node ``h``, a
list item ``li``, a table row ``tr`` and so on, within the HTML elements around it. Nodes
of one block (inline elements such as links and emphasis belong to the block around them)
share a root-to-leaf tag path. For each path the length of text outside links and the
number of punctuation marks are added up and divided by its blocks; both ratios are
smoothed along the order of blocks, fused by their product on a scale of logarithms, and
a path falls if the fused ratio of its blocks is below ``LEAST_SHARE`` of the mean over all
blocks. So navigation, footers and farms of links fall in whatever element they stand, while
links within running text stay with their block. Paths of structure (headings, lists,
tables, code, formulas) are short by nature: they fall only if most of their text is
links as well. Text outside of all elements has no path and stays. What no reader shows
(scripts, styles, comments, templates, categories) is no text node at all.

What is kept: headings as lines of their own, list items as ``- item``, table rows as
``a | b``, code indented by four blanks, formulas as their source between ``$``.

Defined results: a null text stays null with 0 marks; an empty one stays empty; a text
without markup is returned unchanged. Each row is handled by itself, so repeated rows
give repeated results; only the key and the text reach Python.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is never shown, inline elements, and those that begin a line.
HIDDEN = {"script", "style", "head", "noscript", "template", "iframe", "svg", "comment", "category"}
INLINE = {"a", "b", "i", "em", "strong", "span", "sup", "sub", "small", "big", "u", "s", "tt", "font", "abbr", "cite", "q", "ref", "code", "kbd", "var", "mark", "strike", "label"}
BREAKS = {"p", "div", "section", "article", "blockquote", "ul", "ol", "table", "pre", "figure", "br", "hr", "header", "main", "body", "html", "nav", "footer", "aside", "form", "menu"}
#: Threshold of the fused ratio, as a share of its mean over the blocks of a document.
LEAST_SHARE = 0.2
STRUCTURE = {"h", "li", "ul", "ol", "dl", "table", "tr", "pre", "math"}

_TAG = r"<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9]{0,10})(?P<attrs>(?:\s[^<>]*)?)/?>"
#: Marks that stand at the beginning of a line, and those that stand anywhere; each try is spared by its first character.
_AT_LINE = [
    r"(?P<fence>^[ \t]*(?:```|~~~)[^\n`]*\n.*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z))",
    r"(?P<whead>^[ \t]*(?P<eq>={1,6})[ \t]*(?P<whtext>[^=\n]+?)[ \t]*(?P=eq)[ \t]*$)",
    r"(?P<mhead>^[ ]{0,3}#{1,6}[ \t]+(?P<mhtext>[^\n]*?)[ \t]*#*[ \t]*$)",
    r"(?P<uhead>^[ \t]*(?:={4,}|-{4,})[ \t]*$)",
    r"(?P<wtable>^[ \t]*(?:\{\|[^\n]*|\|\}|\|-[^\n]*|\|\+[^\n]*)$)",
    r"(?P<rule>^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$)",
    r"(?P<quote>^[ ]{0,3}>[ ]+)",
]
_ANYWHERE = [
    r"(?P<comment><!--.*?(?:-->|\Z))",
    r"(?P<doctype><!DOCTYPE[^>]*>)",
    rf"(?P<element>{_TAG})",
    r"(?P<entity>&(?:#\d{2,6}|#x[0-9A-Fa-f]{2,6}|[A-Za-z]{2,10}\d?);)",
    r"(?P<begin>\\begin\{(?P<env>[A-Za-z*]+)\})(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?",
    r"(?P<end>\\end\{[A-Za-z*]+\})",
    r"(?P<display>\\\[.*?\\\]|\$\$.+?\$\$|\\\([^\n]*?\\\))",
    r"(?P<inline>(?<![\w$\\])\$(?=[^\s$\d]|\d*[\\^_{=])[^$\n]+?(?<!\s)\$(?![\w$]))",
    r"(?P<lhead>\\(?:part|chapter|(?:sub){0,2}section|paragraph)\*?\{(?P<lhtext>[^{}\n]*)\})",
    r"(?P<void>~?\\(?:label|cite[a-z]*|ref|pageref|index|vspace|hspace|includegraphics|usepackage|documentclass|bibliography[a-z]*)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\})",
    r"(?P<note>\\(?:footnote|marginpar)\{(?P<notetext>[^{}\n]*)\})",
    r"(?P<command>\\(?P<cname>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?(?P<brace>\{)?)",
    r"(?P<escape>\\[%&$#_{}~^]|\\\\)",
    r"(?P<category>\[\[(?:Category|File|Image):[^\[\]]*\]\])",
    r"(?P<wlink>\[\[(?:[^\[\]|]*\|)?(?P<wltext>[^\[\]]*)\]\])",
    r"(?P<image>!\[(?P<alt>[^\[\]\n]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\))",
    r"(?P<mlink>\[(?P<mltext>[^\[\]\n]+)\]\([^()\s]*(?:\s+\"[^\"]*\")?\))",
    r"(?P<xlink>\[https?://\S+(?:\s+(?P<xltext>[^\[\]\n]*))?\])",
    r"(?P<template>\{\{[^{}]*\}\})",
    r"(?P<magic>__(?:NOTOC|TOC|NOEDITSECTION|FORCETOC)__)",
    r"(?P<wquote>'{2,5}(?=[^'\s]))(?P<wqtext>[^\n]+?)(?P<wqend>'{2,5})",
    r"(?P<code>`(?P<ctext>[^`\n]+)`)",
    r"(?P<strong>(?P<sm>\*\*|__)(?=[^\s_*,])(?P<stext>[^*_\n]*[^\s*_])(?P=sm))",
    r"(?P<strike>~~(?=\S)(?P<ktext>[^~\n]*\S)~~)",
    r"(?P<emph>(?<![\w*])\*(?=[^\s*])(?P<etext>[^*\n]*[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_,])(?P<utext>[^_\n]*[^\s_])_(?![\w_]))",
]
_TOKEN = rf"(?=[<&`\\*_~'\[{{$!])(?:{'|'.join(_ANYWHERE)})|^(?=[ \t#=>|{{:`~-])(?:{'|'.join(_AT_LINE)})"
_TOKENS = re.compile(_TOKEN, re.S | re.M)
_ESCAPE = r"&lt;(?:/?[A-Za-z][A-Za-z0-9]{0,10}(?:\s[^<>]*?)?/?|!--.*?--)&gt;"
_ESCAPED = re.compile(_ESCAPE.replace("(?:", "(", 1), re.S)
#: The parser's own patterns as the JVM reads them: rows without a match hold no markup and never reach Python.
MAY_HOLD = "(?smdU)" + f"{_TOKEN}|{_ESCAPE}".replace("(?P<", "(?<").replace("(?P=eq)", r"\k<eq>").replace("(?P=sm)", r"\k<sm>")
#: What every match of the parser holds: a quick test before it.
QUICK = re.compile(r"<[A-Za-z/!]|&(?:#|[A-Za-z])|[`\\]|\*\S|_\S|~~|\[\[|\]\(|\{[{|]|\[http|''|-{3}|\$\S|^[ \t]*(?:[#=>]|\|[-}+])", re.M)
_PUNCT = re.compile(r"[.,;:!?]")
#: Unknown commands without an argument are left alone unless they are among these fixed names of LaTeX.
_SWITCHES = {"it", "bf", "em", "rm", "sc", "tt", "sl", "item", "par", "noindent", "newpage", "clearpage", "hline", "ldots", "dots", "textdegree", "centering", "large", "small", "maketitle", "tableofcontents", "today", "quad", "qquad", "newline", "linebreak", "pagebreak", "bigskip", "medskip", "smallskip", "toprule", "midrule", "bottomrule", "S", "P", "dag", "ddag", "pounds", "copyright", "frac", "times", "cdot", "leq", "geq", "alpha", "beta", "gamma", "delta", "lambda", "mu", "pi", "sum", "sqrt", "left", "right"}
_ENVS = {"itemize": "ul", "enumerate": "ul", "description": "ul", "tabular": "table", "table": "table", "verbatim": "pre", "lstlisting": "pre", "equation": "math", "align": "math", "displaymath": "math", "quote": "blockquote"}


class _Tree:
    """Nodes in document order: (path, text); inline elements do not begin a node."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.nodes: list[tuple[tuple[str, ...], str]] = []
        self.marks = 0

    def text(self, s: str, *more: str) -> None:
        if s:
            path = (*self.stack, *more)
            if self.nodes and self.nodes[-1][0] == path:
                self.nodes[-1] = (path, self.nodes[-1][1] + s)
            else:
                self.nodes.append((path, s))

    def mark(self, s: str, *more: str) -> None:
        self.marks += 1
        self.text(s, *more)

    def open(self, tag: str) -> None:
        if (tag in BREAKS - {"br", "hr"} or tag == "h") and "p" in self.stack:
            self.close("p")  # a block ends a paragraph that was left open
        if tag not in ("br", "hr", "img", "input", "meta", "link"):
            self.stack.append(tag)
        if tag == "ref":
            self.text(" ")
        elif tag == "li":
            self.text("\n- ")
        elif tag in ("td", "th"):
            self.text("" if self.nodes and self.nodes[-1][1].endswith("\n") else " | ")
        elif tag in BREAKS or tag == "tr":
            self.text("\n\n" if tag not in ("br", "table", "ul", "ol", "tr") else "\n")

    def close(self, tag: str) -> None:
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
            if tag in BREAKS:
                self.text("\n\n")


def _parse(text: str) -> _Tree:
    tree, at = _Tree(), 0
    if "&lt;" in text:
        text, n = _ESCAPED.subn(r"<\1>", text)
        tree.marks += n
    braces: list[str] = []
    for m in _TOKENS.finditer(text):
        if m.start() < at:
            continue
        kind = m.lastgroup and next(k for k in _KINDS if m.group(k) is not None)
        tag = m.group("tag")
        if kind == "element" and tree.stack[-1:] == ["pre"] and tag.lower() not in ("pre", "code", "span"):
            continue
        if "math" in tree.stack and not (kind == "element" and tag.lower() == "math") and kind != "end":
            continue
        if tree.stack and tree.stack[-1] in ("script", "style") and not (kind == "element" and tag.lower() == tree.stack[-1]):
            continue
        gap = text[at : m.start()]
        tree.text(_close_braces(gap, braces) if braces else gap)
        at = m.end()
        if kind in ("comment", "doctype"):
            tree.mark(m.group(), "comment")
        elif kind == "element":
            tree.marks += 1
            tag = tag.lower()
            tag = "h" if re.fullmatch(r"h[1-6]", tag) else tag
            (tree.close if m.group("close") else tree.open)(tag)
        elif kind == "entity":
            s = html.unescape(m.group())
            tree.mark(s.replace(" ", " ").replace("​", ""))
        elif kind == "fence":
            tree.mark("\n".join(m.group().strip().split("\n")[1:]).rstrip("`~\n "), "pre")
        elif kind == "begin":
            tree.marks += 1
            tree.open(_ENVS.get(m.group("env").rstrip("*"), "div"))
        elif kind == "end":
            tree.marks += 1
            tree.close(_ENVS.get(m.group()[5:-1].rstrip("*"), "div"))
        elif kind in ("display", "inline"):
            tree.mark(m.group().strip("$") if m.group()[0] == "$" else m.group()[2:-2], "math")
        elif kind in ("lhead", "whead", "mhead"):
            tree.marks += 1
            inner = m.group({"lhead": "lhtext", "whead": "whtext", "mhead": "mhtext"}[kind])
            tree.text("\n\n" + _inner(inner) + "\n\n", "h")
        elif kind == "uhead":
            above = text[: m.start()].rstrip("\n").rsplit("\n", 1)[-1] if text[m.start() - 1 : m.start()] == "\n" else ""
            if 0 < len(above.strip()) <= 90 and not re.search(r"\S {3,}\S", above):
                tree.marks += 1
                tree.text("\n")
            else:
                tree.text(m.group())
        elif kind in ("void", "magic", "wtable", "rule", "quote"):
            tree.marks += 1
            tree.text("\n" if kind == "wtable" else "")
        elif kind == "category":
            tree.mark(m.group(), "category")
        elif kind == "template":
            tree.marks += 1
            lines = [x.strip(" |{}") for x in m.group().split("\n") if "=" in x]
            tree.text("\n" + "\n".join(lines) + "\n" if lines and "\n" in m.group() else "", "tr")
        elif kind == "command":
            name = m.group("cname")
            if m.group("brace"):
                tree.marks += 1
                braces.append(name)
            elif name in _SWITCHES:
                tree.marks += 1
                tree.text("\n- " if name == "item" else "\n" if name in ("par", "hline", "newline") else "…" if name in ("ldots", "dots") else "")
            else:
                tree.text(m.group())
        elif kind == "escape":
            tree.mark("\n" if m.group() == "\\\\" else m.group()[1:])
        else:
            if kind == "note":
                tree.text(" ")
            group = {"wlink": "wltext", "image": "alt", "mlink": "mltext", "xlink": "xltext", "note": "notetext", "wquote": "wqtext", "code": "ctext", "strong": "stext", "strike": "ktext"}.get(kind)
            inner = m.group(group) if group else m.group("etext") or m.group("utext")
            tree.mark(_inner(inner or ""))
    gap = text[at:]
    tree.text(_close_braces(gap, braces) if braces else gap)
    return tree


_KINDS = ["comment", "doctype", "element", "entity", "fence", "begin", "end", "display", "inline", "lhead", "void", "note", "command", "escape", "whead", "mhead", "uhead", "category", "wlink", "image", "mlink", "xlink", "template", "magic", "wtable", "wquote", "rule", "code", "strong", "strike", "emph", "quote"]


def _inner(s: str) -> str:
    """Text within a mark, with the marks in it removed too."""
    if not re.search(r"[*_`~'\[\]<>\\&]", s):
        return s
    sub = _parse(s)
    return "".join(t for p, t in sub.nodes if not HIDDEN & set(p)) if sub.marks else s


def _close_braces(s: str, braces: list[str]) -> str:
    """Drops the closing braces of commands that were opened."""
    out = []
    for c in s:
        if c == "}" and braces:
            braces.pop()
        else:
            out.append(c)
    return "".join(out)


def _content(nodes: list[tuple[tuple[str, ...], str]]) -> list[bool]:
    """Which nodes to keep, by the fused ratios of their tag paths."""
    shown = [not HIDDEN & set(p) for p, _ in nodes]
    paths = [tuple(t for t in p if t not in INLINE) for p, _ in nodes]
    blocks: list[tuple[str, ...]] = []
    # Of each path: letters outside links, letters in links, punctuation, blocks.
    sums: dict[tuple[str, ...], list[float]] = {}
    last, begun = None, False
    for (path, s), p, show in zip(nodes, paths, shown):
        last, begun = p, begun and p == last
        if not show or not s.strip():
            continue
        t = sums.setdefault(p, [0.0, 0.0, 0.0, 0.0])
        if not begun:
            begun = True
            blocks.append(p)
            t[3] += 1
        t["a" in path] += len(s.strip())
        t[2] += len(_PUNCT.findall(s)) if "a" not in path else 0
    if not any(blocks):
        return shown
    raw = [(math.log1p(sums[p][0] / sums[p][3]), math.log1p(sums[p][2] / sums[p][3])) for p in blocks]
    # A narrow kernel: a paragraph must not carry the links beside it.
    weights = [math.exp(-0.5 * (k / 0.5) ** 2) for k in (-1, 0, 1)]
    fused: dict[tuple[str, ...], list[float]] = {}
    for i, p in enumerate(blocks):
        near = [(w, raw[i + k]) for k, w in zip((-1, 0, 1), weights) if 0 <= i + k < len(raw)]
        total = sum(w for w, _ in near)
        length, marks = (sum(w * r[j] for w, r in near) / total for j in (0, 1))
        fused.setdefault(p, []).append(length * (1 + marks))
    all_ = [x for xs in fused.values() for x in xs]
    mean = sum(all_) / len(all_)
    least = LEAST_SHARE * mean
    fallen = {p for p, xs in fused.items() if p and sum(xs) / len(xs) < least and (not STRUCTURE & set(p) or sums[p][1] > sums[p][0])}
    return [show and p not in fallen for show, p in zip(shown, paths)]


def convert(text: str | None) -> tuple[str | None, int]:
    """Clean text and the number of marks that were found."""
    if not text:
        return text, 0
    tree = _parse(text)
    if not tree.marks:
        return text, 0
    out: list[str] = []
    last: tuple[str, ...] = ()
    for keep, (path, s) in zip(_content(tree.nodes), tree.nodes) if tree.nodes else ():
        if not keep:
            continue
        if "pre" in path:
            s = "\n\n" + "\n".join("    " + x for x in s.strip("\n").split("\n")) + "\n\n" if s.strip() else ""
        elif "math" in path:
            s = "$" + s.strip() + "$"
        elif "table" in path or "tr" in path:
            s = re.sub(r"^[ \t]*[|!][ \t]*", "", s, flags=re.M)
            s = re.sub(r"[ \t]*(?:\|\||!!|&)[ \t]*", " | ", s)
        if "h" in path and "h" not in last:
            out.append("\n\n")
        if "h" in last and "h" not in path:
            out.append("\n\n")
        out.append(s)
        last = path
    clean = re.sub(r"[ \t]+\n", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", clean).strip(), tree.marks


def _convert_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [convert(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())],
            [*batch.schema.names[:-1], "clean_text", "n_marks"],
        )


def clean_markup(df: DataFrame, keys: list[str], text: str, only_marked: bool = False) -> DataFrame:
    """``keys``, clean_text and n_marks of each row; with ``only_marked``, of the rows in which marks and content were found."""
    own = df.select(*keys, df[text].alias("_text"))
    may = F.coalesce(F.col("_text").rlike(MAY_HOLD), F.lit(False))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    marked = own.where(may).mapInArrow(_convert_batches, f"{kinds}, clean_text string, n_marks int")
    if only_marked:
        return marked.where("n_marks > 0 AND clean_text != ''")
    rest = own.where(~may).select(*keys, F.col("_text").alias("clean_text"), F.lit(0).alias("n_marks"))
    return marked.unionByName(rest)
