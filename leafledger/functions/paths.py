"""Path expressions. Paths use ``/`` and carry no leading slash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"


def base_name(relpath: Column) -> Column:
    return F.substring_index(relpath, "/", -1)


def dir_name(relpath: Column) -> Column:
    """Everything before the last slash, ``''`` at the top level."""
    cut = F.length(relpath) - F.length(base_name(relpath)) - 1
    return F.when(F.contains(relpath, F.lit("/")), F.left(relpath, cut)).otherwise("")


def extension(relpath: Column) -> Column:
    """From the last dot of the base name, dot included; ``''`` without a dot."""
    base = base_name(relpath)
    return F.when(
        F.contains(base, F.lit(".")), F.concat(F.lit("."), F.substring_index(base, ".", -1))
    ).otherwise("")


def extension_key(relpath: Column) -> Column:
    """Lower-cased extension without its dot; null if the name has no extension."""
    base = base_name(relpath)
    return F.when(F.contains(base, F.lit(".")), F.lower(F.substring_index(base, ".", -1)))


def depth(relpath: Column) -> Column:
    return F.length(relpath) - F.length(F.replace(relpath, F.lit("/"))) + 1


def top_component(relpath: Column) -> Column:
    return F.substring_index(relpath, "/", 1)


def is_dotted(relpath: Column) -> Column:
    """Some component starts with a dot."""
    return F.startswith(relpath, F.lit(".")) | F.contains(relpath, F.lit("/."))


def tree_key(relpath: Column, is_dir: Column | None = None) -> Column:
    """A flat string whose byte order is depth-first tree order.

    Each component becomes flag + name + NUL, with flag ``0`` for a directory
    and ``1`` for a file: directories precede files, parents precede children,
    and names compare bytewise because NUL is below every byte of a name.
    """
    as_dir = F.concat(
        F.lit("0"), F.replace(relpath, F.lit("/"), F.lit(NUL + "0")), F.lit(NUL)
    )
    folder = dir_name(relpath)
    above = F.when(
        folder == "", F.lit("")
    ).otherwise(F.concat(F.lit("0"), F.replace(folder, F.lit("/"), F.lit(NUL + "0")), F.lit(NUL)))
    as_file = F.concat(above, F.lit("1"), base_name(relpath), F.lit(NUL))
    if is_dir is None:
        return as_file
    return F.when(is_dir, as_dir).otherwise(as_file)


def walk_key(relpath: Column) -> Column:
    """Byte order of this key is a plain lexical walk, component by component."""
    return F.replace(relpath, F.lit("/"), F.lit(NUL))
