"""User patterns in Python's dialect, put into Java's."""

from __future__ import annotations

import re
import warnings

# Escapes that both dialects read alike; any other letter after a backslash is refused.
_SHARED_ESCAPES = set("AbBdDsSwWnrtfvaxuU0123456789")
_FLAGS = set("aiLmsux")


class PatternError(ValueError):
    """A pattern that cannot be used, with its text."""


def to_java(pattern: str) -> str:
    """The Java pattern that matches what Python's `re` matches; PatternError names what has no counterpart."""
    def refuse(why: str) -> PatternError:
        return PatternError(f"{why}: {pattern!r}")

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)  # brackets in classes are escaped below
            re.compile(pattern)
    except re.error as err:
        raise refuse(f"not a pattern ({err})") from None
    out, i, in_class, class_start = [], 0, False, 0
    while i < len(pattern):
        c, rest = pattern[i], pattern[i:]
        if c == "\\":
            escaped = pattern[i + 1]
            if escaped == "Z":
                out.append("\\z")
            elif escaped == "N":
                raise refuse("characters by name are not supported")
            elif escaped == "U":
                out.append(f"\\x{{{pattern[i + 2:i + 10]}}}")
                i += 8
            elif escaped == "v":
                out.append("\\x0B")
            elif escaped == "0" or (in_class and escaped.isdigit()):
                digits = re.match(r"[0-7]{1,3}", pattern[i + 1:])[0]
                out.append(f"\\x{int(digits, 8):02x}")
                i += len(digits) - 1
            elif escaped == "b" and in_class:
                out.append("\\x08")
            elif escaped.isalnum() and escaped.isascii() and escaped not in _SHARED_ESCAPES:
                raise refuse(f"the escape \\{escaped} is not supported")
            else:
                out.append(c + escaped)
            i += 2
            continue
        if in_class:
            if c == "]" and i > class_start:
                in_class = False
                out.append(c)
            elif c in "[&^" and not (c == "^" and i == class_start - 1):
                out.append("\\" + c)
            elif c == "]":
                out.append("\\]")
            else:
                out.append(c)
            i += 1
            continue
        if c == "[":
            in_class = True
            class_start = i + 1 + rest.startswith("[^")
            out.append("[^" if rest.startswith("[^") else "[")
            i = class_start
            continue
        if rest.startswith(("(?P", "(?(")):
            raise refuse("named groups of the form (?P...) and conditions are not supported")
        flags = re.match(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?[:)]", rest)
        if flags and set(flags[1]) & set("aLu"):
            raise refuse("the flags a, L and u are not supported")
        if re.match(r"\{,[0-9]+\}", rest):
            out.append("{0")
            i += 1
            continue
        if c == "{" and not re.match(r"\{[0-9]+(,[0-9]*)?\}", rest):
            out.append("\\{")  # a plain brace in Python
            i += 1
            continue
        if c == "}" and not re.search(r"\{[0-9]*,?[0-9]*$", pattern[:i]):
            out.append("\\}")
            i += 1
            continue
        out.append(c)
        i += 1
    return "".join(out)


def check_on_jvm(spark, pattern: str) -> None:
    """Compile once on the driver, so that a bad pattern fails when rules are loaded and not in a task."""
    from py4j.protocol import Py4JJavaError

    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Py4JJavaError as err:
        raise PatternError(f"not supported: {pattern!r} ({err.java_exception.getMessage()})") from None
