"""Problem 5: functions paired with their documentation.

A string- and comment-aware state machine walks each file once. It blanks strings and comments (line ends stay), so
declarations and braces are matched on code alone, and keeps the comments and strings it met with their lines. A function is a
declaration whose parameter list is followed by a body; its end is the matching brace, in Python the indentation.
Documentation is the string that opens a Python body, elsewhere the comment that ends on the line directly above,
with nothing but decorators, annotations or attributes between.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTENSIONS = {"py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rs": "rust"}
MIN_WORDS = 4


class Token(NamedTuple):
    """A comment or string: offsets, first and last line."""

    kind: str
    start: int
    end: int
    first: int
    last: int


class Function(NamedTuple):
    name: str
    kind: str
    signature: str
    start_line: int
    end_line: int
    documentation: str


_JS = r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`"""
_SCANNERS = {
    "python": re.compile(r"""\#[^\n]*|(?P<pre>\b[A-Za-z]{1,2})?(?:\"{3}(?:\\.|(?!\"{3}).)*(?:\"{3}|\Z)|'{3}(?:\\.|(?!'{3}).)*(?:'{3}|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)""", re.S),
    "javascript": re.compile(_JS + r"|(?<=[=(,:;!&|?{}\[+\n])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*", re.S),
    "go": re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|`[^`]*`?|'(?:\\.|[^'\\\n])*'?""", re.S),
    "java": re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|\"{3}(?:\\.|(?!\"{3}).)*(?:\"{3}|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?""", re.S),
    "rust": re.compile(r"""//[^\n]*|/\*|b?r(?P<hash>\#*)".*?(?:"(?P=hash)|\Z)|b?"(?:\\.|[^"\\])*"?|b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.)|[^'\\\n])'""", re.S),
}
_SCANNERS["typescript"] = _SCANNERS["javascript"]


def _template_end(text: str, at: int) -> int:
    """End of the template literal that opens at ``at``; substitutions may hold strings and templates again."""
    i, n = at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and text.startswith("{", i + 1):
            depth, i = 1, i + 2
            while i < n and depth:
                c = text[i]
                if c == "`":
                    i = _template_end(text, i)
                    continue
                if c in "\"'":
                    m = re.compile(r"""(["'])(?:\\.|(?!\1)[^\\\n])*\1?""", re.S).match(text, i)
                    i = m.end() if m else i + 1
                    continue
                depth += (c == "{") - (c == "}")
                i += 1
        else:
            i += 1
    return n


def _nested_end(text: str, at: int) -> int:
    """End of a block comment that may nest (Rust)."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


class Source:
    """A file after the state machine: ``code`` has comments and strings blanked."""

    def __init__(self, text: str, language: str) -> None:
        self.text = text
        self.language = language
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.tokens: list[Token] = []
        parts, at, scanner = [], 0, _SCANNERS[language]
        m = scanner.search(text)
        while m:
            start, end = m.span()
            body = m[0].lstrip(" \t")
            start = end - len(body)
            comment = body.startswith(("//", "/*")) or (language == "python" and body.startswith("#"))
            if body == "`":
                end = _template_end(text, start)
            elif language == "rust" and body == "/*":
                end = _nested_end(text, start)
            line = self.line(start)
            self.tokens.append(Token("comment" if comment else "string", start, end, line, self.line(max(start, end - 1))))
            parts += [text[at:start], re.sub(r"[^\n]", " ", text[start:end]) if comment else "\x01" + re.sub(r"[^\n]", " ", text[start + 1 : end])]
            at = end
            m = scanner.search(text, end) if end > start else None
        parts.append(text[at:])
        self.code = "".join(parts)
        self.ends_at = {t.last: t for t in self.tokens if t.kind == "comment"}
        self.token_starts = [t.start for t in self.tokens]

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def closing(self, at: int, opening: str = "([{", closing: str = ")]}") -> int:
        """Offset of the bracket that closes the one at ``at``; -1 if there is none."""
        depth = 0
        for m in re.compile(r"[()\[\]{}]").finditer(self.code, at):
            depth += 1 if m[0] in opening else -1 if m[0] in closing else 0
            if depth == 0:
                return m.start()
        return -1

    def code_line(self, line: int) -> str:
        return self.code[self.starts[line - 1] : self.starts[line] if line < len(self.starts) else len(self.code)].strip()

    def comment_above(self, line: int) -> str:
        """Text of the comment that ends right above ``line``, past decorators, annotations and attributes."""
        above = line - 1
        while above >= 1:
            token = self.ends_at.get(above)
            code = self.code_line(above)
            if token is not None and not code:
                break
            if self._is_mark(code):
                above -= 1
                continue
            first = self._mark_start(above)
            if not first:
                return ""
            above = first - 1
        else:
            return ""
        first = token
        if self.text.startswith("//", token.start):
            while (t := self.ends_at.get(first.first - 1)) and self.text.startswith("//", t.start) and not self.code_line(t.first):
                first = t
        elif self.code_line(first.first):
            return ""
        return self.text[first.start : token.end]

    def _is_mark(self, code: str) -> bool:
        return bool(re.fullmatch(r"(?:@[\w.]+(?:\s*\(.*\))?\s*)+|(?:#!?\[.*\]\s*)+", code)) and code.count("(") == code.count(")") and code.count("[") == code.count("]")

    @cached_property
    def openings(self) -> dict[int, int]:
        """Offset of the opening bracket of each closing one; closing brackets that fit none are left out."""
        out, open_at = {}, []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            if m[0] in "([{":
                open_at.append(m.start())
                continue
            kind = "([{"[")]}".index(m[0])]
            depth = next((d for d in range(len(open_at) - 1, -1, -1) if self.code[open_at[d]] == kind), -1)
            if depth >= 0:
                out[m.start()] = open_at[depth]
                del open_at[depth:]
        return out

    def _mark_start(self, last: int) -> int:
        """First line of the annotations or attributes, the first of several lines, that end at line ``last``; 0 if there are none."""
        end = self.starts[last - 1] + len(self.code[self.starts[last - 1] : self.starts[last] if last < len(self.starts) else len(self.code)].rstrip())
        while True:
            opened = self.openings.get(end - 1, end)
            begin = self.starts[self.line(min(opened, end - 1)) - 1]
            name = r"#!?$" if self.code.startswith("[", opened) and opened < end else r"@[\w.$]+(?:<[^<>()]*>)?[ \t]*$" if self.code.startswith("(", opened) or opened == end else r"(?!)"
            m = re.search(name, self.code[begin:opened])
            if not m:
                return 0
            before = self.code[begin : begin + m.start()].rstrip()
            if not before.strip():
                return self.line(begin)
            end = begin + len(before)


_NOT_NAMES = {"if", "for", "while", "switch", "catch", "synchronized", "try", "return", "new", "else", "do", "function", "with", "throw", "case", "await", "typeof", "super", "this", "import", "assert", "yield", "delete", "void", "in", "of", "match", "loop"}
_NOT_TYPES = {"return", "new", "else", "throw", "case", "assert", "yield", "package", "import"}
_GO = re.compile(r"(?m)^[ \t]*func[ \t]*(?P<recv>\([^()]*\))?[ \t]*(?P<name>\w+)[ \t]*(?:\[[^\]\n]*\])?[ \t]*\(")
_RUST = re.compile(r"(?m)^[ \t]*(?:(?:pub(?:[ \t]*\([^)]*\))?|default|const|async|unsafe|extern(?:[ \t]*\x01 *)?)[ \t]+)*fn[ \t]+(?P<name>(?:r\#)?\w+)[ \t]*(?:<[^{;(]*>)?[ \t]*\(")
_JAVA = re.compile(
    r"(?m)^[ \t]*(?:@[\w.]+(?:\([^()\n]*\))?[ \t]+)*(?P<mods>(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)[ \t]+)*)"
    r"(?:<[^{;()\n]+>[ \t]+)?(?P<type>[\w.]+(?:<[^{;()\n]*>)?(?:\[\])*[ \t]+)?(?P<name>[A-Za-z_$][\w$]*)[ \t]*\("
)
_JS_FUNCTION = re.compile(r"(?m)^[ \t]*(?:(?:export|default|declare)[ \t]+)*(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>[A-Za-z_$][\w$]*)[ \t]*(?:<[^{;()]*>)?[ \t]*\(")
_JS_BOUND = re.compile(
    r"(?m)^[ \t]*(?:(?:export|default|public|private|protected|static|readonly|override|const|let|var)[ \t]+)*(?P<name>[#A-Za-z_$][\w$]*)[ \t]*(?::[^=\n;(){}]+|:[^=\n;]+=>[^=\n;]+)?(?:=(?![=>])|:)[ \t\n]*"
    r"(?:async\b[ \t]*)?(?:function\b[ \t]*\*?[ \t]*[\w$]*[ \t]*(?:<[^{;()]*>)?[ \t]*(?P<fn>\()|(?:<[^{;()]*>[ \t]*)?(?P<paren>\()|[A-Za-z_$][\w$]*[ \t]*(?P<arrow>=>))"
)
_JS_METHOD = re.compile(r"(?m)^[ \t]*(?:@[\w.]+(?:\([^()\n]*\))?[ \t]+)*(?:(?:public|private|protected|static|async|get|set|readonly|override)[ \t]+)*\*?[ \t]*(?P<name>[#A-Za-z_$][\w$]*)[ \t]*(?:<[^{;()]*>)?[ \t]*\(")
_PYTHON = re.compile(r"(?m)^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?[ \t]*\(")


def _skip_space(code: str, at: int) -> int:
    while at < len(code) and code[at] in " \t\r\n":
        at += 1
    return at


def _type_end(src: Source, at: int, stops: tuple[str, ...]) -> tuple[int, str]:
    """Walks a return type from ``at`` to the first of ``stops`` outside brackets."""
    code, fresh = src.code, True
    while at < len(code):
        for s in stops:
            if code.startswith(s, at) and not (s == "{" and fresh):
                return at, s
        c = code[at]
        if c in "([{":
            at = src.closing(at)
            if at < 0:
                return -1, ""
        if not c.isspace():
            fresh = c in ":|&<,"
        at += 1
    return -1, ""


def _body_go(src: Source, at: int) -> int:
    """Offset of the body behind a parameter list that ends before ``at``, -1 without one; a result type may hold ``interface{}`` or ``struct{}``."""
    code = src.code
    while at < len(code) and code[at] != "\n":
        if code[at] == "{" and not re.search(r"\b(?:interface|struct)[ \t]*$", code[max(0, at - 20) : at]):
            return at
        if code[at] in "([{":
            at = src.closing(at)
            if at < 0:
                return -1
        at += 1
    return -1


def _body_rust(src: Source, at: int) -> int:
    """As ``_body_go``; a brace belongs to the type or the where clause only within ``<>`` (``Rows<{ N }>``)."""
    code, depth = src.code, 0
    while at < len(code) and code[at] != ";":
        if code[at] == "{" and depth <= 0:
            return at
        if code[at] in "([{":
            at = src.closing(at)
            if at < 0:
                return -1
        elif code[at] == "<":
            depth += 1
        elif code[at] == ">" and code[at - 1] not in "-=":
            depth -= 1
        at += 1
    return -1


def _body_js(src: Source, close: int, arrow: bool) -> int:
    """Offset of the body behind a parameter list that closes at ``close``, -1 without one."""
    at = _skip_space(src.code, close + 1)
    stop = ""
    if src.code.startswith(":", at) and src.language == "typescript":
        at, stop = _type_end(src, at + 1, ("=>", ";") if arrow else ("{", ";"))
        if at < 0:
            return -1
    if arrow:
        return _skip_space(src.code, at + 2) if src.code.startswith("=>", at) else -1
    return at if src.code.startswith("{", at) and stop != ";" else -1


def _braced(src: Source) -> Iterator[tuple[str, bool, int, int, int]]:
    """(name, whether it's a method, start of the declaration, of the body, end of the body)."""
    code, lang, seen = src.code, src.language, set()
    found: list[tuple[str, bool, int, int]] = []
    if lang == "go":
        for m in _GO.finditer(code):
            close = src.closing(m.end() - 1)
            if close >= 0:
                at = _body_go(src, close + 1)
                if at >= 0:
                    found.append((m["name"], bool(m["recv"]), m.start(), at))
    elif lang == "rust":
        for m in _RUST.finditer(code):
            close = src.closing(m.end() - 1)
            if close >= 0:
                at = _body_rust(src, close + 1)
                if at >= 0:
                    found.append((m["name"], "self" in re.findall(r"\w+", code[m.end() : close])[:3], m.start(), at))
    elif lang == "java":
        for m in _JAVA.finditer(code):
            if m["name"] in _NOT_NAMES or (m["type"] or "").strip() in _NOT_TYPES or "abstract" in m["mods"].split():
                continue
            close = src.closing(m.end() - 1)
            if close >= 0 and (t := re.compile(r"\s*(?:\[\]\s*)*(?:throws\s+[\w.,\s<>@]+?)?\s*\{").match(code, close + 1)):
                found.append((m["name"], True, m.start(), t.end() - 1))
    else:
        for pattern in (_JS_FUNCTION, _JS_BOUND, _JS_METHOD):
            for m in pattern.finditer(code):
                if m["name"] in _NOT_NAMES:
                    continue
                if pattern is _JS_BOUND:
                    if m["arrow"]:
                        body = _skip_space(code, m.end())
                    else:
                        close = src.closing(m.end() - 1)
                        body = _body_js(src, close, bool(m["paren"])) if close >= 0 else -1
                else:
                    close = src.closing(m.end() - 1)
                    body = _body_js(src, close, False) if close >= 0 else -1
                if body >= 0:
                    found.append((m["name"], pattern is _JS_METHOD, m.start(), body))
    for name, method, start, body in found:
        start = _skip_space(code, start)
        if start in seen:
            continue
        seen.add(start)
        end = src.closing(body) if code.startswith("{", body) else body + len(re.compile(r"[^\n;]*").match(code, body)[0])
        yield name, method, start, body, end if end >= 0 else len(code) - 1


def _own_line(src: Source, start: int) -> int:
    """Offset of the declaration itself where annotations precede it on its line."""
    m = re.compile(r"(?:@[\w.]+(?:\([^()\n]*\))?[ \t]+)*").match(src.code, start)
    return m.end() if m else start


def _one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _indents(src: Source) -> tuple[list[int], list[int], list[int]]:
    """(numbers of the lines that are not blank, their indents, for each the index of the next one that is indented less)."""
    filled, indents = [], []
    for no, start in enumerate(src.starts, 1):
        raw = src.code[start : src.starts[no] if no < len(src.starts) else len(src.code)].expandtabs()
        if raw.strip():
            filled.append(no)
            indents.append(len(raw) - len(raw.lstrip()))
    lower, waiting = [len(filled)] * len(filled), []
    for i, indent in enumerate(indents):
        while waiting and indents[waiting[-1]] > indent:
            lower[waiting.pop()] = i
        waiting.append(i)
    return filled, indents, lower


def _python_functions(src: Source) -> Iterator[Function]:
    filled, indents, lower = _indents(src)
    scopes: list[tuple[int, bool]] = []  # (indent, whether a class) of what is open
    declared = sorted([(m.start(), len(m[1].expandtabs()), None) for m in re.finditer(r"(?m)^([ \t]*)class\b", src.code)] + [(m.start(), len(m["indent"].expandtabs()), m) for m in _PYTHON.finditer(src.code)], key=lambda d: d[0])
    for _, indent, m in declared:
        while scopes and scopes[-1][0] >= indent:
            scopes.pop()
        method = bool(scopes) and scopes[-1][1]
        scopes.append((indent, m is None))
        if m is None:
            continue
        close = src.closing(m.end() - 1)
        if close < 0:
            continue
        colon, stop = _type_end(src, close + 1, (":",))
        if not stop:
            continue
        doc, at = "", colon + 1
        i = bisect_left(src.token_starts, at)
        while i < len(src.tokens) and not src.code[at : src.tokens[i].start].strip():
            token = src.tokens[i]
            if token.kind == "string":
                literal = src.text[token.start : token.end]
                prefix = re.match(r"[A-Za-z]*", literal)[0].lower()
                if set(prefix) <= {"r", "u"}:
                    doc = literal[len(prefix) :]
                    quote = 3 if doc[:3] in ('"""', "'''") else 1
                    doc = doc[quote:-quote]
                break
            at, i = token.end, i + 1
        line = src.line(m.start())
        k = bisect_left(filled, src.line(colon) + 1)
        after = k
        while after < len(filled) and indents[after] > indent:
            after = lower[after]
        kind, end = "method" if method else "function", filled[after - 1] if after > k else line
        yield Function(m["name"], kind, _one_line(src.text[m.start() : colon + 1]), line, end, doc)


def functions(text: str, language: str) -> list[Function]:
    """All functions and methods with a body, by line, each with its documentation ('' without one)."""
    src = Source(text, language)
    if language == "python":
        return sorted(_python_functions(src), key=lambda f: f.start_line)
    out = []
    for name, method, start, body, end in _braced(src):
        start = _own_line(src, start)
        line = src.line(start)
        out.append(Function(name.removeprefix("r#"), "method" if method else "function", _one_line(src.text[start:body]), line, src.line(end), src.comment_above(line)))
    return sorted(out, key=lambda f: f.start_line)


_MARKS = re.compile(r"(?m)^[ \t]*(?:/\*+!?|\*+/|//+!?|\#+!?|\*+(?!/))|\*+/[ \t]*$")
_TAGS = re.compile(r"(?m)^[ \t]*(?:[@\\:](?:param|params|parameter|arg|args|argument|return|returns|throws|throw|raises|raise|exception|type|rtype|see|since|author|version|deprecated|template|typeparam|property|prop|yields|example|todo|private|public|internal|override|async|module|name|function|method|class|memberof|static)\b|@\w+|:\w+(?:[ \t]+[\w\[\], .*]+)?:(?=\s|$)).*$")
#: Where a prompt or note is over: at the end, before an empty line or before tags.
_OVER = r"[^\w\n]*(?:\Z|\n[^\w\n]*\n|\n[^\w\n]*[@:\\]\w)"
_DOC = r"(?:description|documentation|docs?|docstring|summary|comment)"
_SELF = r"(?:this|the) (?:function|method)\b"
#: How documentation begins, after comment marks, that is a note to do, a directive to a tool, a stub
#: left by a generator or a prompt that was never filled in. Directives are told by their syntax, prompts by speaking of
#: the function or its documentation, or of a text to put "here", so that sentences that begin alike are kept.
_TRIVIAL = re.compile(
    r"(?i)\A\W*(?:"
    r"to-?do\b|fixme\b|xxx\b|hack\b|tbd\b|wip\b"
    rf"|nolint\b|no lint(?:\s*:|{_OVER})|noqa\b|eslint(?:-\w|\s+[\w/@-]+\s*:|\s*:|{_OVER})|tslint:|jshint(?:\s+\w+\s*:|\s*:|{_OVER})|jslint(?:\s+\w+\s*:|\s*:|{_OVER})|prettier-ignore|pylint:|pragma(?:\s*:|\s+(?:no|once|warning|mark)\b|{_OVER})|type:\s*ignore|mypy:|flake8[:\-]|ruff:|isort:|fmt:|yapf:|black:|pyright:"
    rf"|nosec\b|nosonar|checkstyle(?:\s*:|[ .-](?:off|on|stop|resume|disable|enable|ignore)\b|{_OVER})|suppress(?:-?warnings)?\s*[:(]|suppress-?warnings\b|suppress checkstyle\b|suppress{_OVER}|spellchecker:|cspell:|istanbul ignore|c8 ignore|v8 ignore|@?ts-(?:ignore|nocheck|expect-error)|rustfmt(?:\s*:|-|_)|clippy:|allow\("
    rf"|go:\w+|\+build|noinspection|biome-ignore|deno-(?:lint|fmt|coverage|ts)|stylelint-(?:disable|enable|ignore)|sonar\s*[-:.]|coverage:|codecov(?:\s*:|-|\s+ignore)|lint:|(?<=\#)(?:end)?region\b|(?-i:(?:end)?region)\b(?:[ \t]+\w+){{0,3}}\Z"
    rf"|auto[- ]?generated(?:\s+(?:method|function|constructor|class|getter|setter|catch block))*(?:\s+(?:stub|code|file|{_DOC}|javadoc|by)\b|\s*[^\w\s]|{_OVER})|code generated by\b|generated\b[^.\n]*\bdo not (?:edit|modify)"
    rf"|generated (?:by|from|with|using)\b[^.\n]{{0,60}}\b(?:tool|generator|scaffold|plugin|codegen|compiler|protoc|openapi|swagger|template|ide)\b|generated (?:(?:method|function) )?(?:stub|code|file){_OVER}|generated(?: signedsource\b|{_OVER})"
    rf"|this (?:method|function|file|comment|stub|code) (?:was|is|has been) (?:auto-?generated|automatically (?:generated|created)|generated (?:by|from|with)|created by)\b|created (?:by|with) (?:intellij|eclipse|netbeans|jetbrains|pycharm|visual studio|xcode)|created by [\w. @-]{{1,40}}\bon \d|non-javadoc|inheritdoc"
    rf"|(?:please )?(?:add|insert|write|enter|put|fill in|provide|describe|document|replace|explain)\b(?:[^.\n]*\b(?:{_DOC}|text|function|method|this|it)\b[^.\n]*\bhere(?:\s*[.!]|{_OVER})|[^.\n]*\b{_DOC} (?:of|for|to|about|on) (?:what )?(?:this (?:function|method)\b|{_SELF}(?: and its \w+)?(?: does)?{_OVER}|it(?: does)?{_OVER})"
    rf"|(?: (?:a|an|the|some|its|your|this|real|proper|short|brief|one-line|meaningful|useful|missing))* {_DOC}{_OVER}|(?: what| how| why| when)? (?:this (?:function|method)\b|(?:{_SELF}|this|it)(?: and its \w+)?(?: (?:does|works|is for|returns))?{_OVER})| this (?:{_DOC}|text|stub)\b)"
    rf"|(?:a |the )?(?:short |brief |one-line )?{_DOC}\b(?:[^.\n]*\bgoes? here\b|[^.\n]*\bhere{_OVER}|(?: (?:of|for) {_SELF})?(?: is| are| still)* (?:to come|pending|missing|tbd|needed){_OVER})|missing {_DOC}(?: (?:of|for) {_SELF})?{_OVER}|undocumented(?: function| method)?{_OVER}"
    rf"|placeholder(?: (?:{_DOC}|text|stub|implementation|function|method))?{_OVER}|placeholder for (?:(?:the|a|an|real|actual|future|missing) )*(?:{_DOC}|implementation)\b|your (?:{_DOC}|text)(?:\b[^.\n]*\bhere\b|{_OVER})"
    r"|this (?:function|method) does what (?:its|the) name|does what (?:it|the) name says|self[- ]explanatory|see (?:the )?(?:name|code|signature|above)\W*$"
    r"|<[^>]*(?:description|summary|doc)[^>]*>\W*$|\[[^\]]*(?:description|summary|doc)[^\]]*\]\W*$|\{[^}]*(?:description|summary|doc)[^}]*\}\W*$"
    r")"
)


def clean_documentation(doc: str) -> str:
    """Documentation without comment marks and without tags and the rest of their lines."""
    return _TAGS.sub("", _MARKS.sub("", doc.replace("\r\n", "\n"))).strip()


def is_trivial(doc: str | None, name: str | None) -> bool:
    """Whether documentation says nothing of this very function; see TRIVIAL and MIN_WORDS."""
    if not doc:
        return True
    plain = _MARKS.sub("", doc.replace("\r\n", "\n")).strip()
    if not plain or _TRIVIAL.match(plain):
        return True
    own = {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+", name or "")} | {(name or "").lower()}
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", clean_documentation(doc).replace(name or "\0", " "))]
    return sum(w not in own for w in words) < MIN_WORDS


def documented_functions(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(file_id, name, kind, signature, start_line, end_line, documentation) of functions with documentation that is not trivial.

    ``files``: file_id, path, language, text. The path's extension decides on the language, else the language column; files
    of other languages give no row. Null texts are looked up in ``symbols`` (file_id, name, kind, start_line, end_line,
    signature, docstring), whose functions and methods count as they stand; without ``symbols`` they give no row. Empty
    texts give no row. Repeated rows give repeated results; rows with a null file_id are left out.
    """
    own = files.where("file_id is not null").select("file_id", F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"\.(\w+)$", 1)).alias("ext"), F.lower(F.coalesce("language", F.lit(""))).alias("lang"), "text")
    schema = "file_id bigint, name string, kind string, signature string, start_line int, end_line int, documentation string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, ext, lang, text in zip(batch["file_id"], batch["ext"], batch["lang"], batch["text"], strict=True):
                language = EXTENSIONS.get(ext) or (lang if lang in _SCANNERS else None)
                if language:
                    rows += [(file_id, f.name, f.kind, f.signature, f.start_line, f.end_line, clean_documentation(f.documentation)) for f in functions(text, language) if not is_trivial(f.documentation, f.name)]
            yield pd.DataFrame(rows, columns=["file_id", "name", "kind", "signature", "start_line", "end_line", "documentation"])

    read = own.where("text is not null and text <> ''").mapInPandas(run, schema)
    if symbols is None:
        return read
    lost = own.where("text is null").select("file_id")
    kept = symbols.where(F.col("file_id").isNotNull() & F.col("docstring").isNotNull()).join(lost, "file_id", "left_semi").select("file_id", "name", "kind", "signature", "start_line", "end_line", "docstring")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for name, kind, signature, doc in zip(batch["name"], batch["kind"], batch["signature"], batch["docstring"], strict=True):
                ok.append(is_function(kind, signature) and not is_trivial(doc, name))
            part = batch[pd.Series(ok, index=batch.index, dtype=bool)]
            yield part.assign(documentation=[clean_documentation(d) for d in part["docstring"]], kind=["method" if (k or "").lower() == "method" else "function" for k in part["kind"]]).drop(columns="docstring")

    return read.unionByName(kept.mapInPandas(keep, schema))


def is_function(kind: str | None, signature: str | None) -> bool:
    """Whether a symbol is a function or method; kind is spelled variously or missing, then the signature decides."""
    k = (kind or "").strip().lower().replace("_", "").replace("-", "").replace(" ", "")
    if re.search(r"class|struct|type|interface|enum|trait|const|var|module|impl|field|property", k):
        return False
    if re.search(r"func|fn|method|def|constructor|arrow|lambda", k):
        return True
    s = (signature or "").strip()
    return bool(s) and not re.match(r"(?:export |default |pub(?:\([^)]*\))? |public |private |protected |static |final |abstract )*(?:class|struct|type|interface|enum|trait|impl|const\s+[\w$]+\s*(?::[^=]+)?=\s*(?!.*(?:=>|function)))\b", s) and "(" in s


__all__ = ["Source", "clean_documentation", "documented_functions", "functions", "is_function", "is_trivial"]
