"""Run options, with their defaults, and the ini file that may set them."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    """format: of results. order: of de-duplicated records, "input" (as they stand in the dataset), "index" or "entity".
    mates: which records without a pair of their own join a linked entity's rows: "right", "both" or "none". na_values:
    texts read as missing. check_ids: refuse datasets whose index repeats. synonyms: the table of SYNONYMS where the
    project names none: "builtin" or the path of a CSV file. multi_line: whether CSV fields may hold line breaks; if
    not, each line is a record, which saves a scan for quotes."""

    format: str = "csv"
    order: str = "input"
    mates: str = "right"
    na_values: tuple[str, ...] = ()
    check_ids: bool = True
    synonyms: str | None = None
    multi_line: bool = True

    def __post_init__(self) -> None:
        if self.order not in ("input", "index", "entity") or self.mates not in ("right", "both", "none"):
            raise ValueError(f"unknown option value: order={self.order}, mates={self.mates}")


SECTION = "twinspan"


def read_options(path: str, base: Options | None = None) -> Options:
    """Options of the file's [twinspan] section over base; na_values are parted by commas. Unknown keys are an error."""
    parser = configparser.ConfigParser()
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    found = dict(parser[SECTION]) if parser.has_section(SECTION) else {}
    if unknown := set(found) - {f.name for f in fields(Options)}:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    values: dict = dict(found)
    if "na_values" in found:
        values["na_values"] = tuple(x.strip() for x in found["na_values"].split(",") if x.strip())
    for flag in ("check_ids", "multi_line"):
        if flag in found:
            values[flag] = parser.getboolean(SECTION, flag)
    return replace(base or Options(), **values)
