"""Facts of TypeScript and JavaScript sources, by a bounded scanner over tokens: the one per-row helper of the graph jobs.

Supported: comments, strings, templates with nested expressions, regular expression literals by the token before them; top-level imports, exports,
functions, classes with their methods, interfaces, type aliases, enums, namespaces, variables; calls, dynamic imports and type
annotations of declarators, parameters, results, ``as`` and type arguments. Not supported: JSX text with quotes or braces that do not
pair, and annotations elsewhere in bodies. Brackets or quotes that do not pair make the file an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.session import ship_package

TOKEN = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?\*/)|(?P<str>'(?:\\[\s\S]|[^'\\\n])*'|"(?:\\[\s\S]|[^"\\\n])*")|(?P<word>\#?[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\d[\w.]*)|(?P<punct>=>|\.\.\.|\?\.(?!\d)|[!=]==?|&&|\|\||\?\?|[^\s\w])""")
#: Closing brackets, tokens of one character that begin no longer one, and tests of a token's beginning and end.
CLOSING, ALONE, NAME, ENDS_VALUE = frozenset("}])"), frozenset("(){}[],;:<>"), re.compile(r"[^\W\d]|\$").match, re.compile(r"[\w$)\]}\"'`]").match
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
PAIRS = {"(": ")", "[": "]", "{": "}"}
# Words of the language that are no names in a value or type position.
CONTROL = frozenset("if for while switch catch return typeof await void delete in of instanceof new throw case do else yield function super import with".split())
TYPE_WORDS = frozenset("string number boolean any unknown void never object symbol bigint undefined null this true false".split())
MODIFIERS = frozenset("public private protected static readonly override abstract async declare accessor get set".split())
OPERATORS = frozenset("= => + - * / % < > & | ^ ! ? : , . ?. && || ?? == != === !== ~ ... (".split())
GOES_ON, CONTINUES = OPERATORS | CONTROL, OPERATORS - {"!", "~"} | {"[", "`", "instanceof", "in", "as", "satisfies", "{"}


class Broken(ValueError):
    pass


def tokenize(text: str) -> tuple[list[str], list[int], list[int], int]:
    """Tokens, their lines, for each opening bracket the index of its partner, and the number of lines."""
    words: list[str] = []
    lines: list[int] = []
    partner: list[int] = []
    stack: list[tuple[str, int]] = []
    at, line, size, match = 0, 1, len(text), TOKEN.match

    def push(word: str) -> None:
        words.append(word)
        lines.append(line)
        partner.append(-1)

    def template(at: int) -> int:
        """Text of a template from ``at`` to its end or its next expression."""
        nonlocal line
        while at < size:
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                return at + 1
            elif text.startswith("${", at):
                push("{")
                stack.append(("${", len(words) - 1))
                return at + 2
            else:
                line += text[at] == "\n"
                at += 1
        raise Broken("template without end")

    while at < size:
        first = text[at]
        if first == " " or first == "\n":
            line += first == "\n"
            at += 1
            continue
        if first == "`":
            push("`")
            at = template(at + 1)
            continue
        if first == "/" and text[at : at + 2] not in ("//", "/*"):
            before = words[-1] if words else "("
            if (before in CONTROL or not ENDS_VALUE(before[-1])) and (m := REGEX.match(text, at)):
                push('"regex"')
                at = m.end()
                continue
        if first in ALONE:
            word, at, group = first, at + 1, "punct"
        elif m := match(text, at):
            word, at, group = m[0], m.end(), m.lastgroup
        else:
            raise Broken("quote without end")
        if group == "skip":
            line += word.count("\n")
            continue
        if group == "word":
            words.append(word)
            lines.append(line)
            partner.append(-1)
            continue
        if word in ("'", '"'):
            raise Broken("quote without end")
        if word in CLOSING:
            if not stack:
                raise Broken("bracket without partner")
            opened, index = stack.pop()
            if (PAIRS.get(opened) or "}") != word:
                raise Broken("brackets do not pair")
            push(word)
            partner[index], partner[-1] = len(words) - 1, index
            if opened == "${":
                at = template(at)
            continue
        push(word)
        if word in PAIRS:
            stack.append((word, len(words) - 1))
        elif group == "str":
            line += word.count("\n")
    if stack:
        raise Broken("bracket without partner")
    return words, lines, partner, text.count("\n") + 1


class Scanner:
    """One file's facts: tuples (fact, ord, name, kind, exported, start, end, owner, specifier)."""

    def __init__(self, text: str):
        self.w, self.line, self.partner, self.n_lines = tokenize(text)
        self.n = len(self.w)
        self.named = [NAME(word) is not None for word in self.w]
        self.facts: list[tuple] = []
        self.decls: list[dict] = []
        self.imports: list[tuple[str, str, str]] = []  # local, imported, specifier
        self.locals: list[tuple[str, str | None]] = []  # name, class that a new expression makes
        self.params: list[tuple[str, str]] = []

    def at(self, i: int) -> str:
        return self.w[i] if 0 <= i < self.n else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < self.n and self.named[i]

    def is_string(self, i: int) -> bool:
        return self.at(i)[:1] in ("'", '"') and self.at(i) != '"regex"'

    def emit(self, fact: str, name=None, kind=None, exported=None, start=None, end=None, owner=None, specifier=None) -> None:
        self.facts.append((fact, len(self.facts), name, kind, exported, start, end, owner, specifier))

    # --- ends of things

    def angle_end(self, i: int) -> int:
        """Index after type arguments that begin at ``i``, or ``i`` if these are none."""
        if not 0 <= i < self.n or self.w[i] != "<":
            return i
        depth, k = 0, i
        while k < self.n:
            word = self.w[k]
            if word in PAIRS:
                k = self.partner[k]
            elif word == "<":
                depth += 1
            elif word == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif not (self.is_name(k) or self.is_string(k) or word in (",", ".", "|", "&", "=>", "?", ":", "=", "...", "`") or word[0].isdigit()):
                return i
            k += 1
        return i

    def value_end(self, i: int, comma: bool) -> int:
        """Index after an expression: a semicolon, a comma if asked, or a line that does not go on."""
        begin = i
        while i < self.n:
            word = self.w[i]
            if word == ";" or word == "," and comma or word in (")", "]", "}"):
                return i
            if i > begin and self.line[i] > self.line[i - 1] and self.w[i - 1] not in GOES_ON and word not in CONTINUES:
                return i
            if word in PAIRS:
                i = self.partner[i]
            elif word == "<" and (k := self.angle_end(i)) > i and self.at(k) in ("(", "`"):
                i = k - 1
            i += 1
        return i

    # --- types

    def type_at(self, i: int, owner: int) -> int:
        """Reads a type, emits its references, returns the index after it."""
        while self.at(i) in ("|", "&"):
            i += 1
        while self.at(i) in ("keyof", "readonly", "unique", "infer", "asserts", "abstract") and (self.is_name(i + 1) or self.at(i + 1) in ("(", "[", "{")) and self.at(i + 1) != "is":
            i += 1
        word = self.at(i)
        if word == "new":
            i, word = i + 1, self.at(i + 1)
        if word == "<":
            end = self.angle_end(i)
            self.type_list(i + 1, end - 1, owner)
            i, word = end, self.at(end)
        if word == "(":
            close = self.partner[i]
            if self.at(close + 1) == "=>":
                self.parameters(i, owner)
                return self.type_at(close + 2, owner)
            self.type_at(i + 1, owner)
            i = close + 1
        elif word == "{":
            self.members_types(i + 1, self.partner[i], owner)
            i = self.partner[i] + 1
        elif word == "[":
            self.type_list(i + 1, self.partner[i], owner)
            i = self.partner[i] + 1
        elif word in ("typeof", "import"):
            i += 1
            if self.at(i) == "(":
                i = self.partner[i] + 1
            elif self.is_name(i):
                i += 1
            while self.at(i) == ".":
                i += 2
            if (end := self.angle_end(i)) > i:
                self.type_list(i + 1, end - 1, owner)
                i = end
        elif self.is_name(i):
            first, parts = word, 1
            i += 1
            if self.at(i) == "is" and self.line[i] == self.line[i - 1]:
                return self.type_at(i + 1, owner)
            while self.at(i) == "." and self.is_name(i + 1):
                parts, i = parts + 1, i + 2
            if parts <= 2 and first not in TYPE_WORDS:
                self.emit("typeref", name=first, owner=owner)
            if (end := self.angle_end(i)) > i:
                self.type_list(i + 1, end - 1, owner)
                i = end
        elif word == "`":
            i += 1
            while self.at(i) == "{":
                self.type_at(i + 1, owner)
                i = self.partner[i] + 1
        elif word:
            i += 2 if word == "-" else 1
        while self.at(i) == "[" and self.line[i] == self.line[i - 1]:
            if self.partner[i] > i + 1:
                self.type_at(i + 1, owner)
            i = self.partner[i] + 1
        if self.at(i) == "extends":
            i = self.type_at(i + 1, owner)
            if self.at(i) == "?":
                i = self.type_at(i + 1, owner)
                if self.at(i) == ":":
                    i = self.type_at(i + 1, owner)
        if self.at(i) in ("|", "&"):
            return self.type_at(i + 1, owner)
        return i

    def type_list(self, i: int, end: int, owner: int) -> None:
        """Types between commas: arguments, tuples with labels, type parameters with constraints and defaults."""
        while i < end:
            if self.at(i) == "...":
                i += 1
            if self.is_name(i) and (self.at(i + 1) == ":" or self.at(i + 1) == "?" and self.at(i + 2) == ":"):
                i += 2 + (self.at(i + 1) == "?")
            i = max(i + 1, self.type_at(i, owner))
            if self.at(i) == "=" and i < end:
                i = self.type_at(i + 1, owner)
            while i < end and self.w[i] != ",":
                i = (self.partner[i] if self.w[i] in PAIRS else i) + 1
            i += 1

    def type_parameters(self, i: int, owner: int | None) -> int:
        """Constraints and defaults of ``<A extends B = C>``; a parameter's own name is no reference."""
        end = self.angle_end(i)
        if owner is not None:
            for k in range(i + 1, end - 1):
                if self.w[k] in ("extends", "="):
                    self.type_at(k + 1, owner)
        return end

    def members_types(self, i: int, end: int, owner: int) -> None:
        """Members of an interface or object type: properties, methods, calls and index signatures."""
        while i < end:
            word = self.w[i]
            if word == "<":
                i = self.type_parameters(i, owner)
            elif word == "(":
                self.parameters(i, owner)
                i = self.partner[i] + 1
            elif word == "[":
                if self.at(i + 2) == ":":
                    self.type_at(i + 3, owner)
                elif self.at(i + 2) == "in":
                    self.type_at(i + 3, owner)
                i = self.partner[i] + 1
            elif word == ":":
                i = self.type_at(i + 1, owner)
            else:
                i += 1

    def parameters(self, i: int, owner: int | None, collect: list | None = None) -> None:
        """Parameters between brackets at ``i``: emits their types, collects (name, type name) of plain typed ones."""
        close, i = self.partner[i], i + 1
        while i < close:
            plain = True
            while self.at(i) == "@":
                i += 2
                if self.at(i) == "(":
                    i = self.partner[i] + 1
            while self.at(i) in MODIFIERS and self.is_name(i + 1):
                plain, i = False, i + 1
            name = self.at(i)
            if name == "...":
                plain, i = False, i + 1
            i = (self.partner[i] if self.at(i) in PAIRS else i) + 1
            plain &= bool(NAME(name))
            if self.at(i) == "?":
                i += 1
            if self.at(i) == ":":
                begin = i + 1
                i = self.type_at(begin, owner) if owner is not None else self.skip_type(begin)
                word = self.at(begin)
                whole = self.is_name(begin) and word not in TYPE_WORDS and self.angle_end(begin + 1) == i
                if collect is not None and plain and whole and self.at(i) != "=":
                    collect.append((name, word))
            while i < close and self.w[i] != ",":
                i = (self.partner[i] if self.w[i] in PAIRS else i) + 1
            i += 1

    def skip_type(self, i: int) -> int:
        kept = len(self.facts)
        end = self.type_at(i, -1)
        del self.facts[kept:]
        return end

    # --- bodies

    def body(self, i: int, end: int, owner: int) -> None:
        """Calls and annotations between two tokens."""
        while i < end:
            word, before = self.w[i], self.at(i - 1)
            if word in ("const", "let", "var") and self.is_name(i + 1) and self.at(i + 2) == ":":
                i = self.type_at(i + 3, owner)
                continue
            if word in ("as", "satisfies") and i and (self.is_name(i - 1) or before[-1] in ")]}'\"`" or before[0].isdigit()) and (self.is_name(i + 1) or self.at(i + 1) in PAIRS):
                i = self.type_at(i + 1, owner)
                continue
            if word == "(":
                close = self.partner[i]
                after = close + 1
                if self.at(after) == ":":
                    after = self.skip_type(after + 1)
                heads = self.at(after) == "=>" or before == "catch" or before == "function" or self.at(i - 2) == "function" or self.at(after) == "{" and self.is_name(i - 1) and before not in CONTROL
                if heads:
                    self.parameters(i, owner)
                    if self.at(close + 1) == ":":
                        self.type_at(close + 2, owner)
            if self.is_name(i) and word not in CONTROL or word == "this":
                self.call(i, owner)
            i += 1

    def call(self, i: int, owner: int) -> None:
        """A call whose callee ends at name ``i``."""
        k = i + 1
        if (end := self.angle_end(k)) > k and self.at(end) == "(":
            self.type_list(k + 1, end - 1, owner)
            k = end
        elif self.at(k) == "?." and self.at(k + 1) == "(":
            k += 1
        if self.at(k) != "(":
            return
        after = self.partner[k] + 1
        if self.at(after) == ":":
            after = self.skip_type(after + 1)
        if self.at(after) == "{" and self.at(i - 1) not in (".", "?.", "extends"):
            return  # a method of an object or class expression
        before = self.at(i - 1)
        if before in (".", "?."):
            obj, ahead = self.at(i - 2), self.at(i - 3)
            if (self.is_name(i - 2)) and ahead not in (".", "?.", "new") and self.w[i][0] != "#":
                self.emit("call", kind="this" if obj == "this" else "member", name=self.w[i], owner=owner, specifier=None if obj == "this" else obj)
        elif before not in ("new", "function", "*") or before == "*" and self.at(i - 2) != "function":
            if self.w[i] not in ("this", "super"):
                self.emit("call", kind="direct", name=self.w[i], owner=owner)

    # --- statements

    def declare(self, name: str, kind: str, exported: int, start: int, end: int, owner: int | None = None) -> int:
        self.emit("decl", name=name, kind=kind, exported=exported, start=self.line[start], end=self.line[min(end, self.n - 1)], owner=owner)
        return len(self.facts) - 1

    def function(self, i: int, start: int, exported: int, in_table: bool) -> int:
        k = i + 1 + (self.at(i + 1) == "*")
        name = self.at(k) if self.is_name(k) else None
        head = k + (name is not None)
        opening = self.angle_end(head)
        if self.at(opening) != "(":
            return i + 1
        close = self.partner[opening]
        brace = self.skip_type(close + 2) if self.at(close + 1) == ":" else close + 1
        if self.at(brace) != "{":
            return self.value_end(brace, False)  # an overload has no body and makes no node
        end = self.partner[brace]
        if name:
            own = self.declare(name, "function", exported, start, end)
            self.type_parameters(head, own)
            collected: list = []
            self.parameters(opening, own, collected)
            if self.at(close + 1) == ":":
                self.type_at(close + 2, own)
            self.body(opening, brace, own)
            self.body(brace, end, own)
            if in_table:
                self.locals.append((name, None))
                self.params += collected
        return end + 1

    def klass(self, i: int, start: int, exported: int, in_table: bool) -> int:
        k = i + 1
        name = self.at(k) if self.is_name(k) and self.at(k) not in ("extends", "implements") else None
        k = self.angle_end(k + (name is not None))
        while k < self.n and self.w[k] != "{":
            k = (self.partner[k] if self.w[k] in PAIRS else k) + 1
        brace, end = k, self.partner[k] if k < self.n else self.n
        if not name or k >= self.n:
            return end + 1
        own = self.declare(name, "class", exported, start, end)
        if in_table:
            self.locals.append((name, None))
        k = self.angle_end(i + 2)
        if self.at(k) == "extends":
            if self.is_name(k + 1) and self.at(self.angle_end(k + 2)) in ("{", "implements"):
                self.emit("heritage", name=self.at(k + 1), kind="class", owner=own)
            while k < brace and self.w[k] != "implements":
                k += 1
        if self.at(k) == "implements":
            k += 1
            while k < brace:
                after = self.angle_end(k + 1)
                if self.is_name(k) and self.at(after) in (",", "{"):
                    self.emit("heritage", name=self.w[k], kind="interface", owner=own)
                while k < brace and self.w[k] != ",":
                    k = max(k + 1, self.angle_end(k))
                k += 1
        self.members(brace + 1, end, own)
        return end + 1

    def members(self, i: int, end: int, owner: int) -> None:
        while i < end:
            if self.w[i] in (";", ","):
                i += 1
                continue
            start = i
            while self.at(i) == "@":
                i += 2
                while self.at(i) == ".":
                    i += 2
                if self.at(i) == "(":
                    i = self.partner[i] + 1
                start = i
            while self.at(i) in MODIFIERS and self.at(i + 1) not in ("(", "=", ":", ";", "?", "<", "!"):
                i += 1
            if self.at(i) == "*":
                i += 1
            named, name = self.is_name(i), self.at(i)
            i = (self.partner[i] if self.at(i) in PAIRS else i) + 1
            if self.at(i) in ("?", "!"):
                i += 1
            opening = self.angle_end(i)
            if self.at(opening) == "(":
                close = self.partner[opening]
                brace = self.skip_type(close + 2) if self.at(close + 1) == ":" else close + 1
                if self.at(brace) == "{":
                    stop = self.partner[brace]
                    if named and name[0] != "#":
                        own = self.declare(name, "constructor" if name == "constructor" else "method", 0, start, stop, owner)
                        self.type_parameters(i, own)
                        self.parameters(opening, own)
                        if self.at(close + 1) == ":":
                            self.type_at(close + 2, own)
                        self.body(opening, brace, own)
                        self.body(brace, stop, own)
                    i = stop + 1
                else:
                    i = brace + 1  # an abstract or overloaded method has no body and makes no node
            else:
                if self.at(i) == ":":
                    i = self.skip_type(i + 1)
                i = self.value_end(i + 1, False) if self.at(i) == "=" else i
                while i < end and self.w[i] == ";":
                    i += 1

    def variables(self, i: int, exported: int, in_table: bool) -> int:
        last: list | None = None
        while True:
            start, plain, name = i, self.is_name(i), self.at(i)
            i = (self.partner[i] if self.at(i) in PAIRS else i) + 1
            i += self.at(i) == "!"
            annotation = i + 1 if self.at(i) == ":" else None
            if annotation:
                i = self.skip_type(annotation)
            begin = i + 1 if self.at(i) == "=" else None
            end = self.value_end(begin, True) if begin else i
            head = begin + (self.at(begin) == "async" and self.at(begin + 1) != "=>") if begin else None
            arrow = self.arrow_at(head) if begin else None
            made = self.at(begin + 1) if begin and self.at(begin) == "new" and self.is_name(begin + 1) and self.at(begin + 2) != "." else None
            if arrow is not None:
                last = []
                opening = self.angle_end(head)
                if self.at(opening) == "(":
                    kept = len(self.facts)
                    self.parameters(opening, None, last)
                    del self.facts[kept:]
            if plain:
                own = self.declare(name, "variable" if arrow is None else "arrow_function", exported, start, max(start, end - 1))
                if arrow is not None:
                    opening = self.type_parameters(head, own)
                    if self.at(opening) == "(":
                        self.parameters(opening, own)
                        if self.at(self.partner[opening] + 1) == ":":
                            self.type_at(self.partner[opening] + 2, own)
                        self.body(opening + 1, arrow, own)
                    self.body(arrow + 1, end, own)
                else:
                    if annotation:
                        self.type_at(annotation, own)
                    if begin:
                        kept = len(self.facts)
                        self.body(begin, end, own)
                        self.facts[kept:] = [(f[0], kept + n, *f[2:]) for n, f in enumerate(x for x in self.facts[kept:] if x[0] != "call")]
                if in_table:
                    self.locals.append((name, made))
            if self.at(end) != ",":
                if in_table and last:
                    self.params += last
                return end + (self.at(end) == ";")
            i = end + 1

    def arrow_at(self, i: int) -> int | None:
        """Index of the => if an arrow function begins at ``i``."""
        if self.is_name(i) and self.at(i + 1) == "=>":
            return i + 1
        opening = self.angle_end(i)
        if self.at(opening) != "(":
            return None
        after = self.partner[opening] + 1
        if self.at(after) == ":":
            after = self.skip_type(after + 1)
        return after if self.at(after) == "=>" else None

    def clause(self, i: int) -> Iterator[tuple[str, str]]:
        """(first, second) names of ``{ a, b as c, type d }``; a string name gives its text."""
        end, i = self.partner[i], i + 1
        plain = lambda k: self.at(k)[1:-1] if self.is_string(k) else self.at(k)
        while i < end:
            if self.at(i) == "type" and self.at(i + 1) not in (",", "}", "as"):
                i += 1
            first = second = plain(i)
            if self.at(i + 1) == "as":
                second, i = plain(i + 2), i + 2
            yield first, second
            while i < end and self.w[i] != ",":
                i += 1
            i += 1

    def import_(self, i: int) -> int:
        k = i + 1
        if self.at(k) == "type" and self.at(k + 1) not in ("from", ",", "="):
            k += 1
        found: list[tuple[str, str]] = []
        while k < self.n and not self.is_string(k):
            if self.at(k) == "{":
                found += [(local, imported) for imported, local in self.clause(k)]
                k = self.partner[k]
            elif self.at(k) == "*":
                found.append((self.at(k + 2), "*"))
                k += 2
            elif self.at(k) in ("=", ";", "("):
                return self.value_end(k, False) + 1  # import x = require(..)
            elif self.is_name(k) and self.at(k) != "from":
                found.append((self.at(k), "default"))
            k += 1
        if k < self.n:
            specifier = self.w[k][1:-1]
            self.emit("import", specifier=specifier)
            self.imports += [(local, imported, specifier) for local, imported in found]
        return k + 1

    def export_(self, i: int) -> int:
        k = i + 1
        if self.at(k) == "type" and self.at(k + 1) in ("{", "*"):
            k += 1
        if self.at(k) == "*":
            while k < self.n and not self.is_string(k):
                k += 1
            self.emit("import", specifier=self.at(k)[1:-1])
            return k + 1
        if self.at(k) == "{":
            end = self.partner[k]
            if self.at(end + 1) == "from":
                specifier = self.at(end + 2)[1:-1]
                self.emit("import", specifier=specifier)
                for local, _ in self.clause(k):
                    self.emit("export_from", name=local, specifier=specifier)
                return end + 3
            for local, _ in self.clause(k):
                self.emit("mark", name=local)
            return end + 1
        if self.at(k) == "default":
            return self.statement(k + 1, 1, False, True)
        if self.at(k) in ("=", "as", "import"):
            return self.value_end(k + 1, False) + 1
        return self.statement(k, 1, True)

    def statement(self, i: int, exported: int = 0, in_table: bool = True, default: bool = False) -> int:
        start = i
        while self.at(i) == "@":
            i += 2
            while self.at(i) == ".":
                i += 2
            if self.at(i) == "(":
                i = self.partner[i] + 1
        while self.at(i) in ("declare", "abstract", "async") and self.is_name(i + 1) and self.line[i] == self.line[i + 1]:
            i += 1
        word, after = self.at(i), self.at(i + 1)
        if word == "import" and after not in ("(", "."):
            return self.import_(i)
        if word == "export":
            return self.export_(i)
        if word == "function":
            return self.function(i, start, exported, in_table)
        if word == "class":
            return self.klass(i, start, exported, in_table)
        if not default:
            if word in ("const", "let", "var") and after != "enum":
                return self.variables(i + 1, exported, in_table)
            i += word == "const"
            word, name = self.at(i), self.at(i + 1)
            if word in ("interface", "type", "enum", "namespace", "module") and self.is_name(i + 1) and self.at(i + 2) in ("{", "=", "<", "extends", "."):
                return self.type_statement(i, start, word, name, exported, in_table)
        if word == "{":
            return self.partner[i] + 1
        return max(i + 1, self.value_end(i, False) + (self.at(self.value_end(i, False)) in (";", ")", "]", "}")))

    def type_statement(self, i: int, start: int, word: str, name: str, exported: int, in_table: bool) -> int:
        kind = {"type": "type_alias", "module": "namespace"}.get(word, word)
        if word == "type":
            head = self.angle_end(i + 2)
            end = self.skip_type(head + 1)
            own = self.declare(name, kind, exported, start, end - 1)
            self.type_parameters(i + 2, own)
            self.type_at(head + 1, own)
            end += self.at(end) == ";"
        else:
            brace = i + 2
            while brace < self.n and self.w[brace] != "{":
                brace = max(brace + 1, self.angle_end(brace))
            if brace >= self.n:
                return self.n
            end = self.partner[brace] + 1
            if self.at(i + 2) == ".":
                return end
            own = self.declare(name, kind, exported, start, end - 1)
            if word == "interface":
                self.type_parameters(i + 2, own)
                for k in range(self.angle_end(i + 2), brace):
                    if self.w[k] == "<" and (stop := self.angle_end(k)) > k:
                        self.type_list(k + 1, stop - 1, own)
                self.members_types(brace + 1, end - 1, own)
            elif word in ("namespace", "module"):
                kept = len(self.facts)
                self.body(brace, end - 1, own)
                self.facts[kept:] = [(f[0], kept + n, *f[2:]) for n, f in enumerate(x for x in self.facts[kept:] if x[0] != "call")]
        if in_table:
            self.locals.append((name, None))
        return end

    def run(self) -> list[tuple]:
        i = 0
        while i < self.n:
            i = max(i + 1, self.statement(i))
        for k in range(self.n - 2):
            if self.w[k] == "import" and self.w[k + 1] == "(" and self.is_string(k + 2) and self.at(k - 1) != ".":
                self.emit("import", specifier=self.w[k + 2][1:-1])
        self.symbols()
        self.emit("end", end=self.n_lines)
        return self.facts

    def symbols(self) -> None:
        """Raw bindings of the file's top level, in the order in which later ones overwrite: imports, declarations, typed parameters."""
        for local, imported, specifier in self.imports:
            self.emit("bind", name=local, kind=imported, specifier=specifier)
        for name, made in self.locals:
            self.emit("local", name=name, kind=made)
        for name, kind in self.params:
            self.emit("param", name=name, kind=kind)


SCHEMA = "path string, fact string, ord int, name string, kind string, exported int, start int, end int, owner int, specifier string"


def file_facts(path: str, content: str | None) -> list[tuple]:
    try:
        if content is None:
            raise Broken("no content")
        return [(path, *fact) for fact in Scanner(content).run()]
    except (Broken, IndexError, RecursionError):
        return [(path, "error", 0, *[None] * 7)]


def scan_facts(files: DataFrame) -> DataFrame:
    """(path, content) -> fact rows; a file that cannot be read gives one ``error`` row and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [name_type.split() for name_type in SCHEMA.split(", ")]
        out = pa.schema([(name, pa.string() if kind == "string" else pa.int32()) for name, kind in fields])
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                rows = [fact for path, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for fact in file_facts(path, content)]
                yield pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows), out)], schema=out)

    ship_package(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, SCHEMA)
