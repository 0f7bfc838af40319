"""String helpers, script arithmetic and edge callbacks as Column expressions."""

from __future__ import annotations

import math
import operator
import os
import random as _random
import socket

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_SPACE = r"[ \t\n\x0B\f\r]"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split(text, delimiters: str, keep_empty: bool = False) -> Column:
    """Fields between any of the characters ``delimiters``. Empty ones are dropped; with keep_empty only a trailing one is."""
    parts = F.split(_col(text), "[" + "".join("\\" + c if not c.isalnum() else c for c in delimiters) + "]", -1)
    if keep_empty:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.filter(parts, lambda p: p != "")


def ltrim(text) -> Column:
    return F.regexp_replace(_col(text), f"^{_SPACE}+", "")


def rtrim(text) -> Column:
    return F.regexp_replace(_col(text), f"{_SPACE}+$", "")


def trim(text) -> Column:
    """Strip all white space that C knows, not blanks alone."""
    return rtrim(ltrim(text))


def endswith(text, end) -> Column:
    return _col(text).endswith(end)


def int_to_string(number) -> Column:
    return _col(number).cast("string")


def string_to_int(text) -> Column:
    return _col(text).try_cast("int")


def shuffled(values: list, seed: int) -> list:
    out = list(values)
    _random.Random(seed).shuffle(out)
    return out


def blocks(values: list, n: int) -> list[list]:
    """n runs of nearly equal length that together hold all values in order."""
    size, more = divmod(len(values), n)
    at = [i * size + min(i, more) for i in range(n + 1)]
    return [values[a:b] for a, b in zip(at, at[1:], strict=False)]


path_exists, file_exists, dir_exists, working_dir, hostname = os.path.exists, os.path.isfile, os.path.isdir, os.getcwd, socket.gethostname


def make_dir(path: str) -> None:
    os.mkdir(path)


def get_env(name: str) -> str:
    return os.environ.get(name, "")


def ip_address() -> str:
    return socket.gethostbyname(socket.gethostname())


#: The script language's functions of columns. ``log`` is the decimal one.
MATH = {
    "sqrt": F.sqrt, "exp": F.exp, "ln": F.ln, "log": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2,
    "random": lambda lo, hi, seed: F.rand(seed) * (hi - lo) + lo,
    "normal": lambda mu, sigma, seed: F.randn(seed) * sigma + mu,
    "ceil": F.ceil, "floor": F.floor, "round": F.round,
}
#: The script language's operators, of columns; ``neg`` and ``!`` take one.
OPERATORS = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "^": F.pow, "neg": operator.neg,
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "&&": operator.and_, "||": operator.or_, "!": operator.invert,
}
PI = math.pi


def nprocs(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def vertex_random(vertex, seed: int) -> Column:
    """The first draw of the 48-bit POSIX generator seeded by vertex + seed: independent of how rows are dealt."""
    low = F.pmod((_col(vertex) + seed).cast("decimal(38,0)"), F.lit(2**32).cast("decimal(38,0)"))
    x0 = (low * 65536 + 13070).cast("decimal(38,0)")
    x1 = F.pmod((F.lit(25214903917).cast("decimal(20,0)") * x0.cast("decimal(17,0)") + 11).cast("decimal(38,0)"), F.lit(2**48).cast("decimal(38,0)"))
    return x1.cast("double") / float(2**48)
