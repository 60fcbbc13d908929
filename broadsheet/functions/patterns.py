"""Configured patterns: written in Python's grammar, checked in it, and run by the JVM's."""

from __future__ import annotations

import re
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

#: An escape, a class of characters, or a construct that the two grammars spell differently.
_PARTS = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P<(?P<open>\w+)>|\(\?P=(?P<back>\w+)\)|\(\?#[^)]*\)|\(\?\((?P<if>\w+)\)", re.DOTALL)


def _group(name: str) -> str:
    """A group's name in letters and digits alone, distinct for distinct names."""
    return "g" + "".join(c if c.isascii() and c.isalnum() else f"x{ord(c):x}x" for c in name)


def translated(pattern: str) -> str:
    """A pattern of Python's grammar in Java's: named groups and references to them, the end of the text, comments, brackets in classes."""

    def spelled(m: re.Match) -> str:
        said = m[0]
        if m["open"]:
            return f"(?<{_group(m['open'])}>"
        if m["back"]:
            return rf"\k<{_group(m['back'])}>"
        if said.startswith("(?#"):
            return ""
        if said == r"\Z":
            return r"\z"
        if said.startswith("["):  # Java nests classes and intersects them with &&
            start = 2 if said.startswith("[^") else 1
            return said[:start] + re.sub(r"\\.|\[|&&|^\]", lambda x: x[0] if x[0].startswith("\\") else "".join("\\" + c for c in x[0]), said[start:-1], flags=re.DOTALL) + "]"
        return said

    return _PARTS.sub(spelled, pattern)


def problem(pattern: str) -> str | None:
    """Why a pattern can't be used; null if it can. Without a session, only Python's grammar is checked."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # of what a later grammar may read otherwise
            re.compile(pattern)
    except (re.error, OverflowError) as e:
        return str(e)
    session = SparkSession.getActiveSession()
    if session is None:
        return None
    try:
        session.sparkContext._jvm.java.util.regex.Pattern.compile(translated(pattern))
    except (Py4JJavaError, PySparkException) as e:
        return f"can't be run: {str(getattr(e, 'java_exception', e)).splitlines()[0]}"
    return None


def usable(patterns: list[str] | None) -> dict[str, str]:
    """The patterns that can be used, each with its translation."""
    return {p: translated(p) for p in patterns or [] if problem(p) is None}
