"""A data source for Hunspell dictionaries: stems, affix rules and settings as rows, and the forms that affixes give.

A .dic file is read by ranges of bytes, a task each; the small .aff file is read by each of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folio.operators.affixes import Dictionary

#: Bytes of a .dic file that a task reads.
PART_BYTES = 4 << 20
#: Settings that name a flag, and those that are numbers.
FLAG_SETTINGS = ("NEEDAFFIX", "PSEUDOROOT", "FORBIDDENWORD", "ONLYINCOMPOUND", "COMPOUNDFLAG", "COMPOUNDBEGIN", "COMPOUNDMIDDLE", "COMPOUNDEND")
OTHER_SETTINGS = ("COMPOUNDMIN",)
#: What the data source can give: `rows` is one of these.
SCHEMAS = {
    "forms": "lang string, form string",
    "stems": "lang string, stem string, flags array<string>",
    "rules": "lang string, prefix boolean, flag string, strip string, add string, condition string, crosses boolean, more array<string>",
    "settings": "lang string, name string, value string",
}


@dataclass
class Rule:
    """One affix: what it takes off, what it adds, for which stems, whether it goes with one at the other end, and flags of its forms."""

    prefix: bool
    flag: str
    strip: str
    add: str
    condition: str
    crosses: bool
    more: list[str]

    def applied(self, stem: str) -> str | None:
        bare = stem[len(self.strip) :] if self.prefix else stem[: len(stem) - len(self.strip)]
        fits = (stem.startswith(self.strip) if self.prefix else stem.endswith(self.strip)) and bare
        if not fits or not re.search(f"^{self.condition}" if self.prefix else f"{self.condition}$", stem):
            return None
        return self.add + bare if self.prefix else bare + self.add


@dataclass
class Affixes:
    """What an .aff file says."""

    style: str = "char"
    aliases: list[str] = field(default_factory=list)
    settings: dict[str, str] = field(default_factory=dict)
    rules: dict[str, list[Rule]] = field(default_factory=dict)

    def flags(self, text: str) -> list[str]:
        """The flags that stand for a stem or an affix, each a string."""
        if self.aliases and text.isdigit():
            text = self.aliases[int(text) - 1] if 0 < int(text) <= len(self.aliases) else ""
        if self.style == "num":
            return [x.strip() for x in text.split(",") if x.strip()]
        return [text[i : i + 2] for i in range(0, len(text), 2)] if self.style == "long" else list(text)


def condition(text: str) -> str:
    """A condition as a regular expression: letters, any letter, and sets of letters, in which nothing else has a meaning."""
    out = []
    for part in re.findall(r"\[\^?[^\]]*\]|.", text):
        if part.startswith("[") and part.endswith("]") and len(part) > 2:
            inner = part[1:-1]
            negated = inner.startswith("^")
            out.append("[" + "^" * negated + "".join(_escaped(c) for c in inner[negated:]) + "]")
        else:
            out.append("." if part == "." else _escaped(part))
    return "".join(out)


def _escaped(letter: str) -> str:
    return letter if letter.isalnum() else "\\" + letter


def read_affixes(text: str) -> Affixes:
    """An .aff file. Rules that come before their flags' style or aliases are told are read after these, as these come first."""
    out, lines = Affixes(), [line.split() for line in text.splitlines()]
    for parts in lines:
        if len(parts) >= 2 and parts[0] == "FLAG":
            out.style = {"UTF-8": "char"}.get(parts[1], parts[1])
    alias_lines = [p[1] for p in lines if len(p) >= 2 and p[0] == "AF"]
    out.aliases = alias_lines[1:]  # the first says how many there are
    crosses: dict[tuple[str, str], bool] = {}
    for parts in lines:
        if len(parts) >= 2 and parts[0] in FLAG_SETTINGS:
            out.settings["NEEDAFFIX" if parts[0] == "PSEUDOROOT" else parts[0]] = out.flags(parts[1])[0]
        elif len(parts) >= 2 and parts[0] in OTHER_SETTINGS:
            out.settings[parts[0]] = parts[1]
        elif len(parts) >= 4 and parts[0] in ("PFX", "SFX"):
            key, flag = (parts[0], parts[1]), (out.flags(parts[1]) or [""])[0]
            if key not in crosses:  # the head: whether it crosses, and how many rules follow
                crosses[key] = parts[2] == "Y"
                continue
            add, _, more = parts[3].partition("/")
            when = parts[4] if len(parts) > 4 else "."
            out.rules.setdefault(flag, []).append(Rule(parts[0] == "PFX", flag, "" if parts[2] == "0" else parts[2], "" if add == "0" else add, condition(when), crosses[key], out.flags(more)))
    return out


def read_stem(line: str, affixes: Affixes) -> tuple[str, list[str]] | None:
    """A stem and its flags from a line of a .dic file; a slash that belongs to the stem has a backslash before it."""
    entry = line.split("\t")[0].strip()
    if not entry:
        return None
    stem, _, flags = entry.replace("\\/", "\0").partition("/")
    return stem.replace("\0", "/").strip(), affixes.flags(flags.split()[0]) if flags.split() else []


def expand(stem: str, flags: list[str], affixes: Affixes) -> set[str]:
    """A stem's forms: by itself, with a suffix or two, and with a prefix that may cross them; words of compounds aren't forms."""
    need, banned, inner = (affixes.settings.get(x) for x in ("NEEDAFFIX", "FORBIDDENWORD", "ONLYINCOMPOUND"))
    if banned in flags and banned is not None:
        return set()
    own = set(flags)
    suffixed = [(stem, None, [], True)]  # form, innermost suffix's flag, flags of the suffixes' forms, whether all cross
    outer: list[list[str]] = [[]]
    for first in (r for rules in affixes.rules.values() for r in rules if not r.prefix):
        if (form := first.applied(stem)) is None:
            continue
        suffixed.append((form, first.flag, first.more, first.crosses))
        outer.append(first.more)
        for second in (r for f in first.more for r in affixes.rules.get(f, []) if not r.prefix):
            if (longer := second.applied(form)) is not None:
                suffixed.append((longer, first.flag, first.more + second.more, first.crosses and second.crosses))
                outer.append(second.more)
    prefixes = [r for rules in affixes.rules.values() for r in rules if r.prefix]
    out = set()
    for (form, flag, more, crosses), last in zip(suffixed, outer, strict=True):
        if (flag is None or flag in own) and not (need is not None and need in (last if flag is not None else own)) and not (inner is not None and inner in own | set(more)):
            out.add(form)
        for p in prefixes:
            if flag is not None and not (crosses and p.crosses) or p.flag not in own | set(more) or flag is not None and flag not in own | set(p.more):
                continue
            if (begun := p.applied(stem)) is None or inner is not None and inner in own | set(more) | set(p.more) or need is not None and need in p.more and flag is None:
                continue
            # the prefix is put before the stem, whatever follows it
            out.add(begun[: len(begun) - len(stem) + len(p.strip)] + form[len(p.strip) :])
    return out


@dataclass
class Part(InputPartition):
    lang: str
    stem: str
    start: int
    stop: int


class HunspellSource(DataSource):
    """Options: path (a folder with <name>.aff and <name>.dic), names as `lang=name,...`, rows (see SCHEMAS), part_bytes.

    A missing file gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "hunspell"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("rows", "forms")]

    def reader(self, schema) -> DataSourceReader:
        return HunspellReader(self.options)


class HunspellReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        size, whole = int(self.options.get("part_bytes", PART_BYTES)), self.options.get("rows", "forms") in ("rules", "settings")
        out = []
        for lang, name in (x.split("=") for x in self.options["names"].split(",")):
            stem = f"{self.options['path']}/{name}"
            if Path(stem + ".aff").is_file() and Path(stem + ".dic").is_file():
                end = 1 if whole else Path(stem + ".dic").stat().st_size
                out += [Part(lang, stem, at, min(end, at + size)) for at in range(0, end, size)]
        return out or [Part("", "", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.stop:
            return
        head = Path(partition.stem + ".aff").read_bytes()
        coding = (re.search(rb"^\s*SET\s+(\S+)", head, re.M) or [b"", b"UTF-8"])[1].decode()
        affixes, rows, lang = read_affixes(head.decode(coding, "replace").removeprefix("﻿")), self.options.get("rows", "forms"), partition.lang
        if rows == "rules":
            yield from ((lang, r.prefix, r.flag, r.strip, r.add, r.condition, r.crosses, r.more) for rules in affixes.rules.values() for r in rules)
        elif rows == "settings":
            yield from ((lang, name, value) for name, value in affixes.settings.items())
        else:
            for line in lines(partition):
                if (read := read_stem(line.decode(coding, "replace"), affixes)) is not None:
                    if rows == "stems":
                        yield lang, *read
                    else:
                        yield from ((lang, form) for form in sorted(expand(*read, affixes)))


def lines(part: Part) -> Iterator[bytes]:
    """The lines that begin within the part's bytes, but for the file's first, which says how many there are."""
    with Path(part.stem + ".dic").open("rb") as file:
        file.seek(max(0, part.start - 1))
        at = file.tell() + len(file.readline())  # the rest of a line that begins before, or the first line
        while at < part.stop:
            line = file.readline()
            if not line:
                return
            at += len(line)
            yield line.rstrip(b"\r\n")


def read_dictionary(spark: SparkSession, path: str, names: str, part_bytes: int = PART_BYTES) -> Dictionary:
    """Dictionaries of a folder, `names` as `lang=name,...`, for recognising words by their affixes."""
    spark.dataSource.register(HunspellSource)
    read = lambda rows: spark.read.format("hunspell").option("path", path).option("names", names).option("rows", rows).option("part_bytes", part_bytes).load()
    return Dictionary(read("stems"), read("rules"), read("settings"))
