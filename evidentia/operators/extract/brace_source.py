"""Symbols and dataflow edges of languages with braces, from their tokens.

No grammar is at hand for these, so source is read as tokens: scopes by braces,
statements by their ends, expressions as member paths, calls and subscripts. It
is a reading of assignments, arguments and returns, not a parser.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

from evidentia.operators.extract.python_source import Edge, Symbol, symbol_name

_SPACE = r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\\n])*'"
_REST = (
    r"(?P<number>\d[\w.]*)|(?P<name>\$?[A-Za-z_]\w*)"
    r"|(?P<op>::|\?->|->|\?\.|:=|=>|===|!==|==|!=|<=|>=|\+=|-=|\*=|/=|&&|\|\||\.=|<<|>>|.)"
)


def _grammar(*strings: str, life: str = "") -> re.Pattern:
    return re.compile("|".join([_SPACE, f"(?P<string>{'|'.join(strings)})", *([f"(?P<life>{life})"] if life else []), _REST]), re.S)


#: Strings and comments by language; a lifetime of Rust is no string.
TOKENS = {
    "rust": _grammar(r'b?r(?P<fence>#*)".*?"(?P=fence)', _DOUBLE, r"'(?:\\[^\n]*?|[^'\\\n])'", life=r"'[A-Za-z_]\w*"),
    "go": _grammar(r"`[^`]*`", _DOUBLE, _SINGLE),
    "java": _grammar(r'"""(?:\\.|.)*?"""', _DOUBLE, _SINGLE),
    "php": _grammar(r"<<<[ \t]*(?P<quote>['\"]?)(?P<label>\w+)(?P=quote)\r?\n(?:.*?\n)??[ \t]*(?P=label)\b", _DOUBLE, r"'(?:\\.|[^'\\])*'"),
    "typescript": _grammar(_DOUBLE, _SINGLE),
}
#: The grammars above with a match for each token and what stands before it; plain names and brackets, which most tokens are, come first.
OUTLINE = {
    name: re.compile(
        r"(?:\s++|//[^\n]*+|/\*.*?(?:\*/|\Z))*+("
        + (r'(?!b?r#*")' if name == "rust" else "") + r"\$?[A-Za-z_]\w*+|[;,(){}\[\]]"
        + re.sub(r"\(\?P<(?:string|life|number|name|op)>", "(?:", p.pattern.removeprefix(_SPACE)) + r"|\Z)", re.S,
    )
    for name, p in TOKENS.items()
}
NAME, NEWLINE = re.compile(r"\$?[A-Za-z_]\w*"), re.compile("\n")
#: A regular expression of JavaScript, and what may stand before one.
REGEX = re.compile(r"/(?![/*])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do await yield".split())


def template_end(text: str, at: int) -> int:
    """Place after the template string that begins at ``at``; what stands in ``${}`` may hold further ones."""
    depth = [-1]  # -1: inside a template's text, else open braces of the code in it
    at += 1
    while at < len(text) and depth:
        c = text[at]
        if depth[-1] < 0:
            if c == "\\":
                at += 1
            elif c == "`":
                depth.pop()
            elif text.startswith("${", at):
                depth.append(0)
                at += 1
        elif c == "`":
            depth.append(-1)
        elif c == "{":
            depth[-1] += 1
        elif c == "}":
            if depth[-1]:
                depth[-1] -= 1
            else:
                depth.pop()
        at += 1
    return min(at, len(text))


ASSIGN = {"=", ":=", "+=", "-=", "*=", "/=", ".="}
CLOSING = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Language:
    members: tuple[str, ...]  # what joins the parts of a path
    functions: tuple[str, ...]  # words before a function's name
    classes: tuple[str, ...]
    bare_methods: bool = False  # name(...) { in a class is a method
    always_method: bool = False
    never_method: bool = False
    callee_assigns: bool = False  # the result of a call carries the callee's name
    selector_assigns: bool = False  # a member path is read whole, as an assignment
    newline_ends: bool = False
    hash_comments: bool = False


# Words of the languages.
LANGUAGES = {
    "rust": Language(("::", "."), ("fn",), ("struct", "enum", "trait"), never_method=True),
    "go": Language((".",), ("func",), ("type",), callee_assigns=True, selector_assigns=True, newline_ends=True),
    "java": Language((".",), (), ("class", "interface", "enum", "record"), bare_methods=True),
    "php": Language(("?->", "->", "::"), ("function",), ("class", "interface", "trait"), always_method=True, hash_comments=True),
    "typescript": Language((".", "?."), ("function",), ("class", "interface", "enum"), bare_methods=True, newline_ends=True),
}
LANGUAGES["tsx"] = LANGUAGES["javascript"] = LANGUAGES["typescript"]
# Words that are no names, in all of the languages and by language.
COMMON_WORDS = (
    "if else for while switch case catch do try return new const let var throw break continue import package static final public private protected "
    "abstract extends implements function class struct enum interface type this self null nil None true false super void int long float double boolean char"
)
OWN_WORDS = {
    "rust": "fn mod pub use impl trait mut ref move unsafe match loop where dyn async await in",
    "go": "func range go defer select chan",
    "java": "instanceof throws synchronized",
    "php": "echo print use match fn trait instanceof",
    "typescript": "await async yield typeof instanceof in of delete",
}
KEYWORDS = {name: frozenset(f"{COMMON_WORDS} {own}".split()) for name, own in OWN_WORDS.items()}


#: Tokens that may begin, follow or end a declaration.
MARKS = {
    name: frozenset(("{", "(", ";", *known.functions, *known.classes, *(("=",) if known.bare_methods else ())))
    for name, known in LANGUAGES.items()
}


@dataclass
class Token:
    kind: str
    text: str
    line: int
    fresh: bool  # first on its line


_NAMES = {id(known): name for name, known in reversed(LANGUAGES.items())}


def name_of(language: Language) -> str:
    return _NAMES[id(language)]


def without_hash_comments(text: str, language: Language) -> str:
    return re.sub(r"(?m)(^|\s)#(?!\[)[^\n]*", r"\1", text) if language.hash_comments and "#" in text else text


def tokens(text: str, language: Language) -> list[Token]:
    text, name = without_hash_comments(text, language), name_of(language)
    match, script = TOKENS[name].match, name == "typescript"
    out, line, fresh, at = [], 1, True, 0
    while at < len(text):
        kind, end = "", at
        if script and text[at] == "`":
            kind, end = "string", template_end(text, at)
        elif script and text[at] == "/" and (
            not out or out[-1].kind == "op" and out[-1].text not in (")", "]", "}") or out[-1].kind == "name" and out[-1].text in BEFORE_REGEX
        ):
            m = REGEX.match(text, at)
            if m:
                kind, end = "string", m.end()
        if not kind:
            m = match(text, at)
            kind, end = m.lastgroup, m.end()  # the outermost group that took part: quotes and labels inside close before it
        piece = text[at:end]
        if kind in ("space", "comment"):
            fresh = fresh or "\n" in piece
        else:
            out.append(Token(kind, piece, line, fresh))
            fresh = False
        line += piece.count("\n")
        at = end
    return out


BRACKETS = frozenset("()[]{}")


def closings(texts: list[str]) -> list[int]:
    """For each token that opens a bracket, the place of the one that closes it; the
    last place where none does. A brace closes what was left open inside."""
    out = [len(texts) - 1] * len(texts)
    stack: list[tuple[int, str]] = []
    open_braces = 0
    for i, t in enumerate(texts):
        if t not in BRACKETS:
            continue
        if t in CLOSING:
            stack.append((i, CLOSING[t]))
            open_braces += t == "{"
        elif stack and (t == stack[-1][1] or t == "}" and open_braces):
            while True:
                at, closer = stack.pop()
                out[at] = i
                if closer == t:
                    break
            open_braces -= t == "}"
    return out


class Outline:
    """The declarations of a source, from the texts of its tokens."""

    def __init__(self, texts: list[str], language: str) -> None:
        self.texts, self.lang, self.closing = texts, LANGUAGES[language], closings(texts)
        self.words, self.marks = KEYWORDS[language], MARKS[language]

    def close(self, at: int) -> int:
        """Place of the token that closes the bracket at ``at``, or of the end."""
        return self.closing[at]

    def is_name(self, at: int) -> bool:
        return NAME.fullmatch(self.texts[at]) is not None

    def declared(self) -> list[tuple[str, str, int, int]]:
        """(kind, name, place of the first token, place of the last one) as :meth:`Reader.run`
        finds them. Only words that declare, ``{``, ``(``, ``;`` and ``=`` are looked at: a
        method shows by its ``(``, a function that is assigned by its ``=``."""
        texts, marks = self.texts, self.marks
        bare, class_words, function_words = self.lang.bare_methods, self.lang.classes, self.lang.functions
        out: list[tuple[str, str, int, int]] = []
        classes: list[int] = []
        i = since = 0  # tokens from ``since`` on were not jumped over
        n = len(texts)
        pending: tuple[str, str, int] | None = None
        while i < n:
            t = texts[i]
            if t not in marks:
                i += 1
                continue
            while classes and i > classes[-1]:
                classes.pop()
            header = None
            if t == "{":
                if pending:
                    end = self.closing[i]
                    out.append((*pending, end))
                    if pending[0] == "class":
                        classes.append(end)
                    pending = None
            elif t == ";":
                pending = None
            elif t in class_words and i + 1 < n and self.is_name(i + 1):
                pending = ("class", texts[i + 1], i)
                i = since = i + 2
                continue
            elif t in function_words:
                header = self.header(i, bool(classes))
            elif bare and i > since and (classes if t == "(" else t == "=" and i + 1 < n and texts[i + 1] in ("(", "async")):
                header = self.header(i - 1, bool(classes))
            if header:
                pending, i = header
                since = i
                continue
            i += 1
            if t == "(":
                i = since = self.closing[i - 1] + 1
        return out

    def header(self, i: int, in_class: bool) -> tuple[tuple[str, str, int], int] | None:
        """A function's header at ``i``: (kind, name, place) and the place after its parameters."""
        texts, lang, n = self.texts, self.lang, len(self.texts)
        t, at, method = texts[i], i, False
        if t in lang.functions:
            at += 1
            if t == "func" and at < n and texts[at] == "(":  # a receiver
                at, method = self.closing[at] + 1, True
            if at + 1 >= n or not self.is_name(at):
                return None
            name, opening = texts[at], at + 1
            while opening < n and texts[opening] not in "({;":
                opening += 1  # type parameters
        elif lang.bare_methods and in_class and i + 1 < n and texts[i + 1] == "(" and t not in self.words and self.is_name(i):
            after = self.closing[i + 1] + 1
            while after < n and (texts[after] in ":,<>[]|." or self.is_name(after)):
                after += 1
            if after >= n or texts[after] != "{" or i and texts[i - 1] in (".", "new", "="):
                return None
            return ("method", t, i), after
        elif lang.bare_methods and i + 2 < n and texts[i + 1] == "=" and self.is_name(i) and (after := self.arrow(i + 2)):
            return ("function", t, i), after
        else:
            return None
        if opening >= n or texts[opening] != "(":
            return None
        after = self.closing[opening] + 1
        while after < n and texts[after] not in "{;":
            after = self.closing[after] + 1 if texts[after] in "([" else after + 1
        if after >= n or texts[after] != "{":
            return None
        method = method or lang.always_method or in_class and not lang.never_method
        return ("method" if method else "function", name, i), after

    def arrow(self, i: int) -> int | None:
        """Place of the brace of ``(...) => {`` at ``i``, if that is what is there."""
        texts, n = self.texts, len(self.texts)
        if texts[i] == "async":
            i += 1
        if i >= n or texts[i] != "(":
            return None
        after = self.closing[i] + 1
        while after < n and texts[after] not in ("=>", "{", ";", ")"):
            after += 1
        if after + 1 < n and texts[after] == "=>" and texts[after + 1] == "{":
            return after + 1
        return None


class Reader(Outline):
    def __init__(self, file: str, text: str, language: Language) -> None:
        self.file, self.tokens = file, tokens(text, language)
        super().__init__([t.text for t in self.tokens], name_of(language))
        self.symbols: list[Symbol] = []
        self.edges: list[Edge] = []

    # --- helpers -----------------------------------------------------------------
    def edge(self, function: str, source: str, target: str, kind: str, line: int) -> None:
        if source != target:
            self.edges.append((symbol_name(self.file, function, source), symbol_name(self.file, function, target), kind, line))

    def path(self, at: int, end: int) -> tuple[str, int]:
        """Member path that begins at a name, and the place after it."""
        text, at = self.tokens[at].text, at + 1
        while at + 1 < end and self.tokens[at].text in self.lang.members and self.tokens[at + 1].kind == "name":
            text, at = text + self.tokens[at].text + self.tokens[at + 1].text, at + 2
        return text, at

    def base(self, path: str) -> str:
        for m in self.lang.members:
            path = path.split(m)[0] if m != "::" or self.lang is not LANGUAGES["rust"] else path
        return path

    # --- expressions ----------------------------------------------------------------
    def read(self, first: int, end: int, function: str, targets: list[str]) -> None:
        """Edges of the expression in a range of tokens; ``targets`` get what it reads.
        What stands in brackets is read before what follows, from a stack: source may nest deeply."""
        open_ = [(first, end, targets)]
        while open_:
            i, end, targets = open_.pop()
            if i >= end:
                continue
            t = self.tokens[i]
            if t.kind != "name" or t.text in self.words and t.text not in ("self", "this"):
                open_.append((i + 1, end, targets))
                continue
            path, after = self.path(i, end)
            following = self.tokens[after].text if after < end else ""
            if following == "!" and after + 1 < end and self.tokens[after + 1].text in "([":  # a macro
                after, following = after + 1, "("
            member = path != t.text and not (self.lang is LANGUAGES["rust"] and "." not in path)
            if following == "(":
                stop = min(self.close(after), end)
                self.arguments(after + 1, stop, function, path)
                if self.lang.callee_assigns:
                    for to in targets:
                        self.edge(function, path, to, "assign", t.line)
                open_ += [(stop + 1, end, targets), (after + 1, stop, [])]
                continue
            for to in targets:
                if following == "[":
                    self.edge(function, self.base(path), to, "subscript", t.line)
                elif member and not self.lang.selector_assigns:
                    self.edge(function, self.base(path), to, "subscript", t.line)
                else:
                    self.edge(function, path, to, "assign", t.line)
            if following == "[":
                stop = min(self.close(after), end)
                open_ += [(stop + 1, end, targets), (after + 1, stop, [])]
            else:
                open_.append((after, end, targets))

    def arguments(self, first: int, end: int, function: str, callee: str) -> None:
        """Arguments that are a plain name, or a selector where those are read whole."""
        for a, b in self.parts(first, end):
            while a < b and (self.tokens[a].text in ("&", "*") or self.tokens[a].text == "mut"):
                a += 1
            if a < b and self.tokens[a].kind == "name" and self.tokens[a].text not in self.words:
                path, after = self.path(a, b)
                if after == b and (path == self.tokens[a].text or self.lang.selector_assigns):
                    self.edge(function, path, callee, "call_arg", self.tokens[a].line)

    def parts(self, first: int, end: int) -> list[tuple[int, int]]:
        """Ranges between top-level commas."""
        out, start, i = [], first, first
        while i < end:
            if self.tokens[i].kind == "op" and self.tokens[i].text in CLOSING:
                i = self.close(i)
            elif self.tokens[i].text == ",":
                out.append((start, i))
                start = i + 1
            i += 1
        return [*out, (start, end)] if start < end else out

    # --- statements --------------------------------------------------------------------
    def statement(self, first: int, end: int, function: str) -> None:
        if first >= end:
            return
        if self.tokens[first].text == "return":
            for a, b in self.parts(first + 1, end):
                names = [t for t in self.tokens[a:b] if t.kind == "name" and (t.text.startswith("$") if self.lang.always_method else True)]
                if (b - a == 1 or self.lang.always_method) and names:
                    for t in names:
                        if t.text not in self.words:
                            self.edge(function, t.text, "<return>", "return", t.line)
            self.read(first + 1, end, function, [])
            return
        i = first
        while i < end:
            t = self.tokens[i]
            if t.kind == "op" and t.text in ASSIGN:
                break
            i = self.close(i) + 1 if t.kind == "op" and t.text in CLOSING else i + 1
        if i >= end:
            self.read(first, end, function, [])
            return
        targets = [x for x in (self.target(a, b) for a, b in self.parts(first, i)) if x]
        values = self.parts(i + 1, end)
        if len(values) == len(targets) > 1:
            for to, (a, b) in zip(targets, values):
                self.read(a, b, function, [to])
        else:
            self.read(i + 1, end, function, targets[:1])

    def target(self, first: int, end: int) -> str | None:
        """What is assigned to: the last name or path before a type or a subscript."""
        found, i = None, first
        while i < end:
            t = self.tokens[i]
            if t.text == ":" and found:
                break
            if t.kind == "name" and t.text not in self.words:
                found, i = self.path(i, end)
                continue
            i = self.close(i) + 1 if t.kind == "op" and t.text in "[(" else i + 1
        return found if found != "_" else None

    # --- scopes -------------------------------------------------------------------------
    def run(self) -> None:
        functions: list[tuple[str, int]] = []  # name, place of the closing brace
        classes: list[int] = []
        start, i, n = 0, 0, len(self.tokens)
        pending: tuple[str, str, int] | None = None  # kind, name, line

        def here() -> str:
            return functions[-1][0] if functions else ""

        while i < n:
            t = self.tokens[i]
            while functions and i > functions[-1][1]:
                functions.pop()
            while classes and i > classes[-1]:
                classes.pop()
            if t.kind == "name" and t.text in self.lang.classes and i + 1 < n and self.tokens[i + 1].kind == "name":
                pending = ("class", self.tokens[i + 1].text, t.line)
                i += 2
                continue
            header = self.header(i, bool(classes))
            if header:
                (kind, name, first), i = header
                pending = (kind, name, self.tokens[first].line)
                continue
            if t.text == "{":
                end = self.close(i)
                if pending:
                    kind, name, line = pending
                    self.symbols.append((kind, name, line, self.tokens[end].line))
                    (classes.append(end) if kind == "class" else functions.append((name, end)))
                    pending = None
                else:
                    self.statement(start, i, here())
                start = i = i + 1
                continue
            if t.text == "(":
                i = self.close(i) + 1
                if i < n and self.lang.newline_ends and self.tokens[i].fresh and self.tokens[i].text not in (".", "{", "?.", ")"):
                    self.statement(start, i, here())
                    start = i
                continue
            if t.text in (";", "}"):
                self.statement(start, i, here())
                start, pending = i + 1, None if t.text == ";" else pending
            elif self.lang.newline_ends and t.fresh and i > start and t.text not in (".", "?.", "{", ")"):
                self.statement(start, i, here())
                start = i
            i += 1
        self.statement(start, n, here())


def extract(file: str, text: str, language: str) -> tuple[list[Symbol], list[Edge]]:
    reader = Reader(file, text, LANGUAGES[language])
    if reader.tokens:
        reader.run()
    return reader.symbols, list(dict.fromkeys(reader.edges))


def symbols(text: str, language: str) -> list[Symbol]:
    """The symbols of :func:`extract` alone: statements are not read, and tokens are texts."""
    lang = LANGUAGES[language]
    name = name_of(lang)
    if name == "typescript" and ("/" in text or "`" in text):  # what begins a template or a regular expression depends on what stands before
        read = tokens(text, lang)
        return [(kind, what, read[first].line, read[last].line) for kind, what, first, last in Outline([t.text for t in read], name).declared()]
    text = without_hash_comments(text, lang)
    found = list(OUTLINE[name].finditer(text))
    while found and not found[-1][1]:  # the end of the text
        found.pop()
    declared = Outline([m[1] for m in found], name).declared()
    if len(declared) < 5:
        line = lambda place: text.count("\n", 0, found[place].start(1)) + 1
    else:
        ends = [m.start() for m in NEWLINE.finditer(text)]
        line = lambda place: bisect_left(ends, found[place].start(1)) + 1
    return [(kind, what, line(first), line(last)) for kind, what, first, last in declared]
