"""A documented subset of Perl, tokenised and turned into fact rows.

Tokens: comments, pod, data sections, heredocs, quotes and quote-like
operators, patterns (by whether a term or an operator is due), numbers,
variables, identifiers, operators. Facts: packages, classes, subs, methods,
variable declarations, uses, calls, assignments, loops, inheritance. What the
subset does not know is skipped token by token; a text that breaks off inside
a quote gives one `unparsed` row.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

WORD = re.compile(r"[^\W\d]\w*(?:(?:::|')[^\W\d]\w*)*(?:::)?")
NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|\d[\d_]*(?:\.(?!\.)\d*)?(?:[eE][+-]?\d+)?|\.\d+")
VARIABLE = re.compile(r"(?:\$#|[$@%&])(?:\{\^?\w+\}|(?:::)?[^\W\d]\w*(?:::\w+)*|\d+)|\$(?:[&`'+!@/\\,;.0_<>\[\]^|~=%:?-]|\$(?![A-Za-z_{$]))|@_|%\+")
OPERATOR = re.compile(r"<=>|\*\*=|\|\|=|&&=|//=|<<=|>>=|\.\.\.|->|=>|\+\+|--|\*\*|=~|!~|==|!=|<=|>=|&&|\|\||//|\.\.|::|\+=|-=|\*=|/=|\.=|%=|x=|&=|\|=|\^=|<<|>>|.", re.DOTALL)
SPACE = re.compile(r"[^\S\n]+")
HEREDOC = re.compile(r"<<(~?)(?:\"([^\"\n]*)\"|'([^'\n]*)'|([A-Za-z_]\w*))")
#: Kinds of tokens that are no code.
APART = ("comment", "pod", "heredoc", "data")
PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
# Quote-like operators with their number of parts.
QUOTE_LIKE = {"q": 1, "qq": 1, "qw": 1, "qx": 1, "qr": 1, "m": 1, "s": 2, "tr": 2, "y": 2}
# Words after which a term is due.
BEFORE_TERM = {"return", "and", "or", "not", "if", "unless", "while", "until", "split", "grep", "map", "join", "push", "print", "x", "lt", "gt", "le", "ge", "eq", "ne", "cmp", "xor", "when", "die"}
# Words that never name a called function.
KEYWORDS = {"my", "our", "local", "state", "sub", "package", "use", "no", "require", "if", "elsif", "else", "unless", "while", "until", "for", "foreach", "return", "last", "next", "redo", "do", "eval", "class", "method", "field", "given", "when", "default", "and", "or", "not", "xor", "x", "lt", "gt", "le", "ge", "eq", "ne", "cmp", "BEGIN", "END", "INIT", "CHECK", "UNITCHECK", "try", "catch", "finally", "__PACKAGE__", "__FILE__", "__LINE__", "__END__", "__DATA__", "undef", "continue"}
ASSIGNMENTS = {"=", "+=", "-=", "*=", "/=", ".=", "%=", "x=", "&=", "|=", "^=", "**=", "||=", "&&=", "//=", "<<=", ">>="}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    #: For qw and the like: the text between the delimiters.
    body: str = ""


def tokenize(text: str) -> list[Token]:
    """All tokens but white space; offsets count characters."""
    out: list[Token] = []
    at, term, pending = 0, True, []
    n = len(text)

    def emit(kind: str, end: int, body: str = "") -> None:
        nonlocal at
        out.append(Token(kind, text[at:end], at, end, body))
        at = end

    while at < n:
        c = text[at]
        if c == "\n":
            at += 1
            for label, indented in pending:
                margin = r"[^\S\n]*" if indented else ""
                stop = re.compile(rf"^{margin}{re.escape(label)}$", re.MULTILINE).search(text, at)
                end = stop.start() if stop else n
                emit("heredoc", end)
                at = min(n, stop.end() if stop else n)
            pending = []
            if text.startswith("=", at) and re.match(r"=[A-Za-z]", text[at : at + 2]):
                stop = re.compile(r"^=cut\b.*$", re.MULTILINE).search(text, at)
                emit("pod", stop.end() if stop else n)
            continue
        if m := SPACE.match(text, at):
            at = m.end()
            continue
        if at == 0 and re.match(r"=[A-Za-z]", text):
            stop = re.compile(r"^=cut\b.*$", re.MULTILINE).search(text)
            emit("pod", stop.end() if stop else n)
            continue
        if c == "#":
            end = text.find("\n", at)
            emit("comment", n if end < 0 else end)
            continue
        if term and (m := HEREDOC.match(text, at)):
            pending.append((next(g for g in m.groups()[1:] if g is not None), bool(m[1])))
            emit("heredoc_start", m.end())
            term = False
            continue
        if c in "\"'`":
            end = _close(text, at, c, c)
            emit("string" if end else "unparsed", end or n)
            term = False
            continue
        if (m := VARIABLE.match(text, at)) and not (c in "%&" and not term):
            emit("variable", m.end())
            term = False
            continue
        if m := NUMBER.match(text, at):
            emit("number", m.end())
            term = False
            continue
        if m := WORD.match(text, at):
            word = m[0]
            if word in ("__END__", "__DATA__"):
                emit("marker", m.end())
                if at < n:
                    emit("data", n)
                continue
            after = text[m.end() : m.end() + 2]
            arrow = bool(out) and out[-1].text == "->"
            if word in QUOTE_LIKE and not arrow and not re.match(r"\s*=>|\s*[,;)=}]", text[m.end() : m.end() + 20]) and after.strip() and (bracket := _delimiter(text, m.end())) is not None:
                end, body = _quote_like(text, bracket, QUOTE_LIKE[word])
                emit(word if end else "unparsed", end or n, body)
                term = False
                continue
            emit("word", m.end())
            term = word in BEFORE_TERM
            continue
        if c == "/" and term:
            end = _close(text, at, "/", "/")
            if end:
                end = re.compile(r"[a-z]*").match(text, end).end()
            emit("pattern" if end else "unparsed", end or n)
            term = False
            continue
        m = OPERATOR.match(text, at)
        emit("operator", m.end())
        term = m[0] not in (")", "]", "}")
    return out


def _delimiter(text: str, at: int) -> int | None:
    m = re.compile(r"\s*").match(text, at)
    place = m.end()
    if place >= len(text) or text[place].isalnum() or text[place] in "_,;" or (text[place] == "#" and place > at) or (text[place] == "=" and text[place : place + 2] == "=>"):
        return None
    return place


def _close(text: str, at: int, opening: str, closing: str) -> int | None:
    """End of what opens at `at`, past its closing delimiter."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == closing and (opening != closing or i > at):
            depth -= 1 if opening != closing else 0
            if depth <= 0:
                return i + 1
        elif c == opening and opening != closing:
            depth += 1
        i += 1
    return None


def _quote_like(text: str, at: int, parts: int) -> tuple[int | None, str]:
    opening = text[at]
    closing = PAIRS.get(opening, opening)
    end = _close(text, at, opening, closing)
    if end is None:
        return None, ""
    body = text[at + 1 : end - 1]
    if parts == 2:
        if opening in PAIRS:
            second = _delimiter(text, end)
            end = _close(text, second, text[second], PAIRS.get(text[second], text[second])) if second is not None else None
        else:
            end = _close(text, end - 1, opening, opening)
        if end is None:
            return None, ""
    return re.compile(r"[a-z]*").match(text, end).end(), body


@dataclass
class Facts:
    symbols: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    deps: set[str] = field(default_factory=set)
    imports: list[dict] = field(default_factory=list)
    inherits: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    scopes: list[dict] = field(default_factory=list)
    unparsed: list[Token] = field(default_factory=list)


def strings_of(tokens: list[Token]) -> list[str]:
    """The words of strings and lists among tokens."""
    out: list[str] = []
    for t in tokens:
        if t.kind == "string":
            out.append(t.text[1:-1])
        elif t.kind == "qw":
            out += t.body.split()
        elif t.kind == "word" and t.text[0].isupper():
            out.append(t.text)
    return out


class Levels:
    """Where blocks, statements and argument lists end, looked up by the level of brackets that they end at."""

    def __init__(self, tokens: list[Token], size: int):
        self.tokens, self.size = tokens, size
        self.all, self.round, self.semicolons = [0], [0], []
        self.ends: dict[int, list[int]] = {}
        self.closed: dict[int, list[int]] = {}
        for j, t in enumerate(tokens):
            level, inner = self.all[-1], self.round[-1]
            if t.kind == "operator":
                level += (t.text in "{([") - (t.text in "})]") if len(t.text) == 1 else 0
                inner += (t.text == "(") - (t.text == ")")
                if t.text == ")":
                    self.closed.setdefault(inner, []).append(j)
            if t.text == ";":
                self.semicolons.append(j)
            if t.text == ";" or (t.text == "}" and t.kind == "operator"):
                self.ends.setdefault(level, []).append(j)
            self.all.append(level)
            self.round.append(inner)

    def block_end(self, i: int) -> int:
        """Offset past the block or statement that begins at token i."""
        found = self._next(self.ends.get(self.all[min(i, len(self.tokens))], []), i)
        return self.size if found is None else self.tokens[found].end

    def closing(self, i: int) -> int:
        """Offset past the bracket that closes the one at token i."""
        found = self._next(self.closed.get(self.round[i], []), i)
        return self.tokens[-1].end if found is None else self.tokens[found].end

    def semicolon(self, i: int) -> int:
        """The first token from i on that is a semicolon, or how many tokens there are."""
        found = self._next(self.semicolons, i)
        return len(self.tokens) if found is None else found

    @staticmethod
    def _next(places: list[int], i: int) -> int | None:
        at = bisect_left(places, i)
        return places[at] if at < len(places) else None


def extract(text: str, code: list[Token] | None = None) -> Facts:
    """Facts of one file.

    The package in force is the last one declared, not a stack. Calls are
    referenced by bare and by qualified name; static method calls only by the
    qualified one, others only by the bare one. Compound assignments, ++ and
    -- read and write; a loop variable is written and then read. A sub that is
    declared again in its package moves its symbol.
    """
    facts = Facts()
    tokens = [t for t in tokenize(text) if t.kind not in APART] if code is None else code
    levels, known = Levels(tokens, len(text)), {}
    facts.unparsed = [t for t in tokens if t.kind == "unparsed"]
    package: str | None = None
    callables: list[tuple[str, int]] = []  # (name, depth at which its body closes)
    depth, next_scope = 0, 1
    scopes = [0]
    facts.scopes.append({"id": 0, "parent": None, "kind": "Global", "sb": 0, "eb": len(text)})
    opened: dict[int, dict] = {0: facts.scopes[0]}
    body_kind = None

    def ref(name: str, kind: str, start: int, end: int) -> None:
        facts.refs.append({"name": name, "kind": kind, "sb": start, "eb": end})

    def symbol(name: str, kind: str, start: int, end: int, variable: str | None = None, qualified: str | None = None, container: str | None = None, declaration: str | None = None) -> dict:
        facts.symbols.append({"name": name, "kind": kind, "var_kind": variable, "qualified_name": qualified, "container_name": container, "declaration": declaration, "scope_id": scopes[-1], "sb": start, "eb": end})
        return facts.symbols[-1]

    def declare(i: int, word: str) -> int:
        """Declares the variables after my, our, local or state; returns the next token's place."""
        many = i < len(tokens) and tokens[i].text == "("
        i += many
        while i < len(tokens) and tokens[i].kind == "variable":
            t = tokens[i]
            kind = {"@": "Array", "%": "Hash"}.get(t.text[0], "Scalar")
            symbol(t.text, "Variable", t.start, t.end, variable=kind, container=package, declaration=word)
            ref(t.text, "Definition", t.start, t.end)
            i += 1
            if not many:
                return i
            if i < len(tokens) and tokens[i].text == ",":
                i += 1
        return i + 1 if many and i < len(tokens) and tokens[i].text == ")" else i

    i = 0
    while i < len(tokens):
        t = tokens[i]
        nxt = tokens[i + 1] if i + 1 < len(tokens) else None
        before = tokens[i - 1] if i else None
        member = before is not None and before.text == "->"
        key = nxt is not None and nxt.text == "=>"
        if t.kind == "operator" and t.text == "{":
            depth += 1
            facts.scopes.append({"id": next_scope, "parent": scopes[-1], "kind": body_kind or "Block", "sb": t.start, "eb": len(text)})
            opened[next_scope] = facts.scopes[-1]
            scopes.append(next_scope)
            next_scope += 1
            body_kind = None
        elif t.kind == "operator" and t.text == "}":
            depth -= 1
            if len(scopes) > 1:
                opened[scopes.pop()]["eb"] = t.end
            while callables and callables[-1][1] >= depth:
                callables.pop()
        elif t.kind == "word" and t.text in ("package", "class") and nxt and nxt.kind == "word" and not member and not key:
            package = nxt.text.rstrip(":")
            symbol(package, "Package" if t.text == "package" else "Class", t.start, levels.block_end(i + 2) if t.text == "class" else nxt.end, qualified=package)
            body_kind = "Package"
            if t.text == "class":
                i = _skip_attributes(tokens, i + 2, package, facts)
                continue
            i += 2
            continue
        elif t.kind == "word" and t.text in ("sub", "method") and nxt and nxt.kind == "word" and not member and not key:
            name, end = nxt.text, levels.block_end(i + 2)
            qualified = f"{package}::{name}" if package else name
            if t.text == "sub":
                if (package, name) in known:
                    known[package, name].update(sb=t.start, eb=end)
                else:
                    known[package, name] = symbol(name, "Subroutine", t.start, end, qualified=qualified, container=package)
                ref(name, "Definition", t.start, end)
            else:
                symbol(name, "Method", t.start, end, qualified=qualified, container=package)
            callables.append((qualified, depth))
            body_kind = "Subroutine"
            i += 2
            continue
        elif t.kind == "word" and t.text in ("use", "no") and nxt and nxt.kind == "word" and not member and not key:
            stop = levels.semicolon(i + 2)
            module, listed = nxt.text, strings_of(tokens[i + 2 : stop])
            facts.deps.add(module)
            if t.text == "use":
                ref(module, "Import", t.start, tokens[min(stop, len(tokens) - 1)].end)
                facts.imports.append({"module": module, "symbols": listed, "sb": t.start})
                if module in ("parent", "base"):
                    facts.inherits += [{"child": package or "main", "parent": p} for p in listed if p != "-norequire"]
            i = stop
            continue
        elif t.kind == "word" and t.text in ("my", "our", "local", "state", "field") and not member and not key:
            first = tokens[i + 1] if nxt else None
            i = declare(i + 1, t.text)
            if t.text == "our" and first is not None and first.text == "@ISA" and i < len(tokens) and tokens[i].text == "=":
                stop = levels.semicolon(i)
                facts.inherits += [{"child": package or "main", "parent": p} for p in strings_of(tokens[i:stop])]
            continue
        elif t.kind == "word" and t.text in ("for", "foreach") and nxt and not member and not key:
            j = i + 1
            if tokens[j].text in ("my", "our", "state") and j + 1 < len(tokens) and tokens[j + 1].kind == "variable":
                j = declare(j + 1, tokens[j].text)
            elif tokens[j].kind == "variable":
                ref(tokens[j].text, "Write", tokens[j].start, tokens[j].end)
                ref(tokens[j].text, "Read", tokens[j].start, tokens[j].end)
                j += 1
            i = j
            continue
        elif t.kind == "variable":
            after = nxt.text if nxt else ""
            element = after in ("[", "{") and t.text[0] == "$"
            if after in ASSIGNMENTS and not element:
                if after != "=":
                    ref(t.text, "Read", t.start, t.end)
                ref(t.text, "Write", t.start, t.end)
            elif after in ("++", "--") or (before is not None and before.text in ("++", "--")):
                ref(t.text, "Read", t.start, t.end)
                ref(t.text, "Write", t.start, t.end)
            else:
                ref(t.text, "Read", t.start, t.end)
        elif t.kind == "word" and member and t.text not in ("class",):
            target = tokens[i - 2] if i > 1 else None
            static = target is not None and target.kind == "word"
            name = f"{target.text}::{t.text}" if static else t.text
            start = target.start if target else t.start
            ref(name, "Usage", start, t.end)
            facts.calls.append({"caller": callables[-1][0] if callables else (package or "main"), "callee": t.text, "kind": "method", "sb": start, "eb": t.end})
        elif t.kind == "word" and nxt is not None and nxt.text == "(" and t.text not in KEYWORDS:
            bare = t.text.rsplit("::", 1)[-1]
            owner = t.text.rsplit("::", 1)[0] if "::" in t.text else (package or "main")
            end = levels.closing(i + 1)
            ref(bare, "Usage", t.start, end)
            ref(f"{owner}::{bare}", "Usage", t.start, end)
            facts.calls.append({"caller": callables[-1][0] if callables else (package or "main"), "callee": bare, "kind": "function", "sb": t.start, "eb": end})
        i += 1
    return facts


def _skip_attributes(tokens: list[Token], i: int, package: str, facts: Facts) -> int:
    """Past a class's attributes; :isa names a parent."""
    while i < len(tokens) and tokens[i].text not in ("{", ";"):
        if tokens[i].text == "isa" and i + 2 < len(tokens) and tokens[i + 1].text == "(":
            facts.inherits.append({"child": package, "parent": tokens[i + 2].text})
        i += 1
    return i


def pragma_states(text: str, code: list[Token] | None = None) -> list[dict]:
    """(sb, strict_vars, strict_subs, strict_refs, warnings) from each change on; blocks restore what was before them."""
    state = dict.fromkeys(("strict_vars", "strict_subs", "strict_refs", "warnings"), False)
    saved, out = [], []
    tokens = [t for t in tokenize(text) if t.kind not in APART] if code is None else code
    levels = Levels(tokens, len(text))
    for i, t in enumerate(tokens):
        if t.text == "{" and t.kind == "operator":
            saved.append(dict(state))
        elif t.text == "}" and t.kind == "operator" and saved:
            old = saved.pop()
            if old != state:
                state = old
                out.append({"sb": t.end, **state})
        elif t.kind == "word" and t.text in ("use", "no") and i + 1 < len(tokens) and tokens[i + 1].text in ("strict", "warnings"):
            stop = levels.semicolon(i)
            listed = strings_of(tokens[i + 2 : stop])
            names = ["warnings"] if tokens[i + 1].text == "warnings" else [f"strict_{x}" for x in (listed or ["vars", "subs", "refs"]) if x in ("vars", "subs", "refs")]
            state.update(dict.fromkeys(names, t.text == "use"))
            out.append({"sb": t.start, **state})
    return out


class Places:
    """UTF-8 offsets, lines and UTF-16 columns of the characters of one text, from tables that are made once."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.wide = None
        if not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            self.wide = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))]).tolist()
            self.units = np.concatenate([[0], np.cumsum(1 + (points >= 0x10000))]).tolist()

    def byte(self, offset: int) -> int:
        return offset if self.wide is None else self.wide[offset]

    def of(self, offset: int) -> tuple[int, int, int]:
        """(byte, line, column) of a character."""
        line = bisect_right(self.starts, offset) - 1
        start = self.starts[line]
        return self.byte(offset), line, offset - start if self.wide is None else self.units[offset] - self.units[start]


def rows(uri: str, text: str, with_tokens: bool = False, with_pragmas: bool = False) -> Iterator[dict]:
    """Fact rows of one file with line and UTF-16 column positions; its tokens and pragma states, too, if asked for. The text is read once."""
    every = tokenize(text)
    code = [t for t in every if t.kind not in APART]
    facts, places = extract(text, code), Places(text)

    def row(fact: str, **values) -> dict:
        out = {"uri": uri, "fact": fact, **values}
        if "sb" in values:
            out["sb"], out["sl"], out["sc"] = places.of(values["sb"])
        if "eb" in values:
            out["eb"], out["el"], out["ec"] = places.of(values["eb"])
        return out

    yield from (row("symbol", **s) for s in facts.symbols)
    yield from (row("ref", **r) for r in facts.refs)
    yield from (row("dep", name=d) for d in sorted(facts.deps))
    yield from (row("import", name=i["module"], symbols=i["symbols"], sb=i["sb"]) for i in facts.imports)
    yield from (row("inherits", name=i["child"], other=i["parent"]) for i in facts.inherits)
    yield from (row("call", name=c["caller"], other=c["callee"], kind=c["kind"], sb=c["sb"], eb=c["eb"]) for c in facts.calls)
    yield from (row("scope", scope_id=s["id"], parent=s["parent"], kind=s["kind"], sb=s["sb"], eb=s["eb"]) for s in facts.scopes)
    yield from (row("unparsed", name=t.text[:40], sb=t.start, eb=t.end) for t in facts.unparsed)
    if with_tokens:
        yield from ({"uri": uri, "fact": "token", "seq": i, "kind": t.kind, "text": t.text, "sb": places.byte(t.start), "eb": places.byte(t.end)} for i, t in enumerate(every))
    if with_pragmas:
        yield from ({"uri": uri, "fact": "pragma", **state, "sb": places.byte(state["sb"])} for state in pragma_states(text, code))
