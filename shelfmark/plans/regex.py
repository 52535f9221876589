"""Regular expressions: the searched dialect in Java's syntax, and literals for pruning.

The dialect is linear-time: no look-around, no back-references; ``$`` is the end of the text only,
``.`` excludes line feeds only, classes are Unicode.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as P

#: Longest pattern in bytes.
PATTERN_BYTES = 1024
#: Shortest literal worth a prefilter, in bytes.
LITERAL_BYTES = 3


def check_length(pattern: str) -> None:
    if len(pattern.encode()) > PATTERN_BYTES:
        raise ValueError(f"patterns have {PATTERN_BYTES} bytes at most")


# The ASCII classes of the dialect, and the escapes that it shares with Java.
ASCII = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": r"\x20-~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
ESCAPES = "dDsSwWbBAzntrfav"


class _Translator:
    """Reads a pattern of the dialect once: its Java form, and a skeleton with classes masked for literals."""

    def __init__(self, pattern: str) -> None:
        self.p, self.i = pattern, 0
        self.lines = False  # whether a flag makes $ the end of a line

    def take(self, n: int = 1) -> str:
        self.i += n
        return self.p[self.i - n : self.i]

    def escape(self, in_class: bool) -> str:
        c = self.p[self.i + 1 : self.i + 2]
        if not c:
            raise ValueError("a pattern cannot end with a backslash")
        if c in "pP":
            m = re.compile(r"\\[pP](?:\{(\^?)([^}]*)\}|(\w))").match(self.p, self.i)
            if not m:
                raise ValueError("a property needs a name")
            self.i = m.end()
            name = (m[2] or m[3]).split("=")[-1].split(":")[-1]
            return f"\\{'P' if (c == 'P') != bool(m[1]) else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}"
        if c in "xuU":
            m = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|[xuU]\{([0-9A-Fa-f]+)\})").match(self.p, self.i)
            if not m:
                raise ValueError("a code point needs hexadecimal digits")
            self.i = m.end()
            return f"\\x{{{next(g for g in m.groups() if g)}}}"
        if c in "<>" and not in_class:
            self.i += 2
            return r"\b(?=\w)" if c == "<" else r"\b(?<=\w)"
        if c.isascii() and c.isalnum() and (c not in ESCAPES or (in_class and c in "bBAz")):
            raise ValueError(f"the escape \\{c} is not supported")
        if c == "b" and self.p[self.i + 2 : self.i + 3] == "{":
            raise ValueError("word boundaries have no options")
        self.i += 2
        return {"v": r"\x0B"}.get(c, "\\" + c)

    def set(self) -> str:
        """A character class from its opening bracket on; classes nest, and && is their intersection."""
        out = self.take()
        if self.p[self.i : self.i + 1] == "^":
            out += self.take()
        first = True
        while True:
            c = self.p[self.i : self.i + 1]
            if not c:
                raise ValueError("a character class is not closed")
            two = self.p[self.i : self.i + 2]
            if c == "]" and not first:
                return out + self.take()
            named = re.compile(r"\[:(\^?)(\w+):\]").match(self.p, self.i)
            if named:
                if named[2] not in ASCII:
                    raise ValueError(f"there is no class {named[2]}")
                out += f"[{named[1]}{ASCII[named[2]]}]"
                self.i = named.end()
            elif c == "[":
                out += self.set()
            elif c == "\\":
                out += self.escape(True)
            elif two in ("--", "~~") and not first:
                raise ValueError(f"the set operation {two} is not supported")
            elif two == "&&":
                out += self.take(2)
            else:
                out += "\\" + self.take() if c in "&]#~" else self.take()
            first = False

    def group(self) -> str:
        """An opening parenthesis with what follows its question mark."""
        m = re.compile(r"\(\?(?:P?<[A-Za-z_][\w.\[\]]*>|([a-zA-Z-]*)([:)]))").match(self.p, self.i)
        if self.p[self.i + 1 : self.i + 2] != "?":
            return self.take()
        if not m:
            raise ValueError("look-around is not supported" if re.compile(r"\(\?<?[=!]").match(self.p, self.i) else "this kind of group is not supported")
        self.i = m.end()
        if m[2] is None:
            return "("  # names are of no use here, and Java has fewer
        if bad := set(m[1]) - set("ims-"):
            raise ValueError(f"the flags {''.join(sorted(bad))} are not supported")
        self.lines |= "m" in m[1].split("-")[0]
        return m[0].replace("i", "iu") if "i" in m[1].split("-")[0] else m[0]

    def run(self) -> tuple[str, str]:
        out, bare, repeated = [], [], False
        while self.i < len(self.p):
            c, at = self.p[self.i], self.i
            if c == "\\":
                java = self.escape(False)
                mask = self.p[at : self.i] if re.fullmatch(r"\\[^A-Za-z0-9<>]", self.p[at : self.i]) else "(?:.|.)"
            elif c == "[":
                java, mask = self.set(), "(?:.|.)"
            elif c == "(":
                java = self.group()
                mask = java
            elif c == "$":
                self.i += 1
                java = mask = "$"
            elif c == "+" and repeated:
                raise ValueError("a repetition cannot be repeated")
            else:
                java = mask = self.take()
            m = re.compile(r"\{\d*(?:,\d*)?\}").match(self.p, at)
            if m:
                self.i = m.end()
                java = mask = m[0]
            repeated = bool(m) or c in "*+?"
            out.append(java)
            bare.append(mask)
        if not self.lines:
            out = [r"\z" if x == "$" else x for x in out]
        return "".join(out), "".join(bare)


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for Java's engine; raises ``ValueError`` for what the dialect does not have, and for
    what Java's engine does not take, here and not on the executors."""
    check_length(pattern)
    out = ("(?dUiu)" if ignore_case else "(?dU)") + _Translator(pattern).run()[0]
    from pyspark import SparkContext

    context = SparkContext._active_spark_context  # of any thread
    if context is not None:
        from py4j.protocol import Py4JJavaError
        from pyspark.errors.exceptions.captured import CapturedException

        try:
            context._jvm.java.util.regex.Pattern.compile(out)
        except (Py4JJavaError, CapturedException) as e:
            raise ValueError(f"invalid pattern: {e}") from None
    return out


def quoted(literal: str) -> str:
    """A literal as a Java pattern."""
    return re.sub(r"([^\w])", lambda m: "\\" + m[1] if m[1].isascii() and not m[1].isspace() else m[1], literal, flags=re.A)


def _walk(nodes, backwards: bool) -> tuple[str, bool]:
    """(literal at this end, whether the nodes are exactly that literal)."""
    out = ""
    for op, arg in reversed(nodes) if backwards else nodes:
        if op is C.LITERAL:
            text, whole = chr(arg), True
        elif op is C.AT:
            continue
        elif op is C.SUBPATTERN and not arg[1] and not arg[2]:
            text, whole = _walk(list(arg[3]), backwards)
        else:
            return out, False
        out = text + out if backwards else out + text
        if not whole:
            return out, False
    return out, True


def literals(pattern: str) -> tuple[str | None, str | None]:
    """(prefix, suffix): texts that every match contains, or None where there is none of use."""
    if re.search(r"(?<!\\)\(\?[a-zA-Z-]*[a-zA-Z]", pattern) and not re.search(r"\(\?P?<", pattern):
        return None, None  # flags
    try:
        nodes = list(P.parse(_Translator(pattern).run()[1]))
    except (re.error, ValueError):
        return None, None
    found = (_walk(nodes, False)[0], _walk(nodes, True)[0])
    return tuple(x if len(x.encode()) >= LITERAL_BYTES else None for x in found)
