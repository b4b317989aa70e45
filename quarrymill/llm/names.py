"""Freely typed values to the entries of a reference list, by a symmetric-delete dictionary.

The reference list is a small table of fixed size (61 rows; `MOST_ENTRIES` is checked). Each entry is spelled out into
the forms people write; a form and its deletes (of the first `PREFIX` letters, up to two) go into a dictionary that
every Python worker builds from the rows it gets with the task. A typed value is stripped of its decoration, looked up
as it stands, then through its own deletes; candidates within two slips (Damerau-Levenshtein) are ranked by a weighted
distance in which doubled, swapped and neighbouring keys cost less, then by how often the entry is named without a slip
in the data, then by reference_id. Digits allow no slip. Most words of three letters are within two slips of each other, so
in a form of three letters a slip is two letters swapped or one doubled. "Or later" and the like after a version are
decoration, however they are spelled: they name the entry of that version.

Defined results: null and blank values give no row; what names no entry, or a family of several entries without saying
which, gives reference_id 0; ties are broken as above; an empty reference list gives 0 throughout; equal values give
equal results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.runtime import Stage

MOST_ENTRIES = 10_000
SLIPS, PREFIX = 2, 8

#: Other names in use for the licences of the public SPDX list, without their versions.
OTHER_NAMES = {
    "mit": ["mit", "expat", "mitx11"],
    "apache": ["asl", "apachesoftware", "apachesoftwarelicense"],
    "gpl": ["gnugpl", "gnugeneralpublic"],
    "lgpl": ["gnulgpl", "lessergpl", "gnulessergpl"],
    "agpl": ["gnuagpl", "afferogpl", "gnuafferogpl"],
    "mpl": ["mozillapublic", "mozilla"],
    "epl": ["eclipsepublic", "eclipse"],
    "eupl": ["europeanunionpublic"],
    "bsl": ["boost", "boostsoftware"],
    "artistic": ["perlartistic"],
    "ccby": ["creativecommonsattribution", "creativecommonsby"],
    "ccbysa": ["creativecommonsattributionsharealike", "creativecommonsbysa"],
    "cc0": ["creativecommonszero", "cczero", "creativecommons0"],
    "zlib": ["zliblibpng", "zliblibpngstylezlib", "libpngzlib"],
    "bsd2clause": ["bsd2", "2clausebsd", "simplifiedbsd", "bsd2clauses", "freebsd", "bsdtwoclause", "twoclausebsd"],
    "bsd3clause": ["bsd3", "3clausebsd", "newbsd", "newbsd3clauses", "newbsd3clause", "bsd3clauses", "modifiedbsd", "revisedbsd", "bsdthreeclause", "threeclausebsd"],
    "0bsd": ["zeroclausebsd", "bsdzeroclause", "bsd0clause", "0clausebsd", "bsd0"],
    "unlicense": ["unlicense"],
    "isc": ["isc"],
}
#: Families of which several entries are members; naming one alone says nothing.
FAMILIES = ["gpl", "gnugpl", "gnu", "lgpl", "gnulgpl", "bsd", "creativecommons", "cc", "gnulesser", "gnugeneralpublic", "gnulessergeneralpublic"]

_AROUND = re.compile(
    r"^(?:(?:this (?:is|file is|work is)\s+)?(?:(?:dual[- ])?licen[cs]ed|released|distributed|available|published)?\s*under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?|(?:spdx[- ])?licen[cs]e(?:[- ]identifier)?\s*[:=]\s*)"
    r"|(?:[,;]?\s*\(?\s*(?:see|cf\.?)\s+(?:the\s+)?licen[cs]e(?:\.\w+)?(?:\s+file)?\s*\)?|\s+only\s+for\s+.*|\s+for\s+(?:the\s+)?code\b.*)$"
)
_TOOL = re.compile(r"^(?:mcp__[^_]+(?:_[^_]+)*__|tools?\s*[:/]\s*|functions?\s*[:.]\s*)")
_ARGS = re.compile(r"\s*[(\[{].*$", re.S)
_NOT = re.compile(r"[^\w]|_", re.U)
_DIGITS = re.compile(r"\D+")
_VERSION = re.compile(r"^(.*?)[- ](\d+(?:\.\d+)*)$")
#: Fixed value: the rows of a keyboard, for slips to a neighbouring key.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEXT = {frozenset(p) for row in _ROWS for p in zip(row, row[1:], strict=False)} | {
    frozenset((a, b)) for up, low in zip(_ROWS, _ROWS[1:], strict=False) for i, a in enumerate(up) for b in low[max(0, i - 1) : i + 1]
}


def squeeze(text: str) -> str:
    """Letters and digits of the text after NFKC, in lower case; licence is spelled license."""
    return _NOT.sub("", unicodedata.normalize("NFKC", text).lower()).replace("licence", "license")


# What may follow a version without changing which entry is named.
AFTER_VERSION = ("oranylaterversion", "orlaterversion", "oranylater", "orlater", "orabove", "ornewer", "plus", "international")


def bare(squeezed: str) -> str:
    """A squeezed reading without what may follow its version."""
    key = squeezed.removesuffix("license")
    if key.endswith(AFTER_VERSION):
        end = next(e for e in AFTER_VERSION if key.endswith(e))
        return key.removesuffix(end) or squeezed
    return squeezed


def forms(field: str, canonical: str, long_name: str | None) -> set[str]:
    """The squeezed forms that name an entry without a slip."""
    if field != "declared_license":
        return {squeeze(x) for x in (canonical, long_name) if x} - {""}
    out = {squeeze(canonical), squeeze(long_name or "")} - {""}
    short = re.sub(r"-only$|-or-later$", "", canonical.lower())
    version = ""
    if m := _VERSION.match(short):
        short, version = m.groups()
    long_base = unicodedata.normalize("NFKC", long_name or "").lower()
    if m := _VERSION.match(long_base):
        long_base, version = m.group(1), version or m.group(2)
    elif version and version in long_base:
        long_base = long_base.replace(version, " ")
    key = squeeze(short)
    bases = {key, squeeze(long_base), *OTHER_NAMES.get(key, [])} - {""}
    for b in list(bases):
        for x in (b.removeprefix("the"), b.removesuffix("universal")):
            bases |= {x, x.removesuffix("license"), x.removesuffix("license") + "license"}
    bases -= {"", "license"}
    if not version:
        return out | bases
    versions = {version.replace(".", ""), re.sub(r"(\.0)+$", "", version).replace(".", "")}
    for b in bases:
        for v in versions:
            for mark in ("", "v", "version", "ver"):
                for end in ("", "only", "license"):
                    out.add(b + mark + v + end)
    return out | bases


def slips(a: str, b: str, most: int = SLIPS) -> tuple[int, float] | None:
    """(number, weight) of insertions, deletions, substitutions and swaps of neighbours between a and b; None beyond `most`."""
    if abs(len(a) - len(b)) > most:
        return None
    before: list[tuple[int, float]] = []
    row = [(j, float(j)) for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        older, before, x = before, row, a[i - 1]
        row = [(i, float(i))]
        low = i
        for j in range(1, len(b) + 1):
            y = b[j - 1]
            n, w = before[j - 1]
            best = (n, w) if x == y else (n + 1, w + (0.8 if frozenset((x, y)) in _NEXT else 1.0))
            n, w = before[j]
            best = min(best, (n + 1, w + (0.6 if i > 1 and x == a[i - 2] else 1.0)))
            n, w = row[j - 1]
            best = min(best, (n + 1, w + (0.6 if j > 1 and y == b[j - 2] else 1.0)))
            if i > 1 and j > 1 and x != y and x == b[j - 2] and y == a[i - 2]:
                n, w = older[j - 2]
                best = min(best, (n + 1, w + 0.7))
            row.append(best)
            low = min(low, best[0])
        if low > most:
            return None
    return row[-1] if row[-1][0] <= most else None


def deletes(text: str, most: int = SLIPS) -> set[str]:
    """The first PREFIX letters of text, and these with up to `most` letters left out."""
    out = last = {text[:PREFIX]}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


class Resolver:
    """entries: (reference_id, field, canonical_value, long_name); named: how often each entry is named without a slip."""

    def __init__(self, entries: list[tuple[int, str, str, str | None]], named: dict[int, int] | None = None):
        self.named = named or {}
        self.exact: dict[tuple[str, str], int] = {}
        self.near: dict[tuple[str, str], list[str]] = {}
        self.canonical = {i: c for i, _, c, _ in entries}
        owners: dict[tuple[str, str], set[int]] = {}
        own: dict[tuple[str, str], int] = {}
        for ref, field, canonical, long_name in sorted(entries, key=lambda e: e[0]):
            for form in forms(field, canonical, long_name):
                owners.setdefault((field, form), set()).add(ref)
            for text in (canonical, long_name):
                if text:
                    own.setdefault((field, squeeze(text)), ref)
        for k, refs in owners.items():
            self.exact[k] = own[k] if k in own else next(iter(refs)) if len(refs) == 1 else 0
        for family in FAMILIES:
            for end in ("", "license"):
                if ("declared_license", family + end) not in own:
                    self.exact["declared_license", family + end] = 0
        # forms that begin alike have the same deletes
        self.alike: dict[tuple[str, str], list[str]] = {}
        for field, form in self.exact:
            if len(form) > 2:
                self.alike.setdefault((field, form[:PREFIX]), []).append(form)
        for field, beginning in self.alike:
            for x in deletes(beginning):
                self.near.setdefault((field, x), []).append(beginning)
        self.known: dict[tuple[str, str], int] = {}

    def readings(self, field: str, value: str) -> list[str]:
        """Squeezed readings of a typed value, from the value as it stands to its barest form."""
        text = unicodedata.normalize("NFKC", value).lower().strip(" \t\r\n,;.'\"`*")
        out = [text]
        if field == "declared_license":
            for _ in range(3):
                text = _AROUND.sub("", text).strip(" \t\r\n,;.'\"`*")
            out += [text, _ARGS.sub("", text)]
            out += [x.removeprefix("the ") for x in out]
        else:
            text = _TOOL.sub("", text)
            out += [text, _ARGS.sub("", text)]
        keys = [squeeze(x) for x in out]
        if field == "declared_license":
            keys += [bare(x) for x in keys]
        return [s for s in dict.fromkeys(keys) if s]

    def plain(self, field: str, value: str) -> int | None:
        """The entry named without a slip, 0 for a family, None if there is none."""
        for s in self.readings(field, value):
            if (field, s) in self.exact:
                return self.exact[field, s]
        return None

    def slipped(self, field: str, squeezed: str) -> tuple | None:
        """The best (number of slips, weight, -named, reference_id) for a squeezed reading."""
        best = None
        if len(squeezed) < 3:
            return None
        digits = _DIGITS.sub("", squeezed)
        for beginning in {b for x in deletes(squeezed) for b in self.near.get((field, x), ())}:
            for form in self.alike[field, beginning]:
                if abs(len(form) - len(squeezed)) > SLIPS or _DIGITS.sub("", form) != digits:
                    continue
                d = slips(squeezed, form)
                if d is not None and (len(form) > 3 or d[1] <= len(form) / 4):
                    ref = self.exact[field, form]
                    rank = (d[0], d[1], -self.named.get(ref, 0), ref)
                    if best is None or rank < best:
                        best = rank
        return best

    def resolve(self, field: str, value: str) -> int:
        key = (field, value)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.plain(field, value)
            if found is None:
                near = [r for s in self.readings(field, value) if (r := self.slipped(field, s)) is not None]
                found = min(near)[3] if near else 0
            self.known[key] = found
        return self.known[key]


@lru_cache(4)
def resolver_of(entries: tuple, named: tuple = ()) -> Resolver:
    """The resolver of a list; a Python worker keeps it from task to task."""
    return Resolver(list(entries), dict(named))


def entries_of(reference: DataFrame) -> list[tuple[int, str, str, str | None]]:
    """The reference list; it must not grow with the data."""
    rows = reference.select("reference_id", "field", "canonical_value", "long_name").where("canonical_value IS NOT NULL").distinct().limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries")
    return [(r[0], r[1], r[2], r[3]) for r in rows]


def latest(df: DataFrame, key: str, when: str, columns: list[str]) -> DataFrame:
    """One row for each key: that of the latest `when`."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.col(when), F.struct(*[c for c in columns]))).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in columns])


def _values(skills: DataFrame) -> DataFrame:
    one = latest(skills, "skill_id", "last_seen_at", ["declared_license", "allowed_tools"])
    listed = F.concat(
        F.array(F.struct(F.lit("declared_license").alias("field"), F.lit(0).alias("pos"), F.col("declared_license").alias("value"))),
        F.coalesce(
            F.transform("allowed_tools", lambda v, i: F.struct(F.lit("allowed_tools").alias("field"), i.alias("pos"), v.alias("value"))),
            F.array().cast("array<struct<field:string,pos:int,value:string>>"),
        ),
    )
    return one.select("skill_id", F.inline(listed)).where(F.col("value").isNotNull() & F.col("value").rlike(r"[^\p{Z}\s,]"))


def resolved_values(skills: DataFrame, reference: DataFrame) -> DataFrame:
    """(skill_id, field, pos, value, reference_id) for every value that holds more than blanks and commas."""
    entries = tuple(sorted(entries_of(reference)))
    values = Stage(skills.sparkSession, "names").write(_values(skills), "values")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolver, named = resolver_of(entries), Counter()
        for batch in batches:
            for field, value, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if ref := resolver.plain(field, value):
                    named[ref] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(named), pa.int32()), pa.array(list(named.values()), pa.int64())], names=["reference_id", "n"])

    counted = values.groupBy("field", "value").count().mapInArrow(count, "reference_id int, n long").groupBy("reference_id").agg(F.sum("n").alias("n"))
    named = tuple(sorted((r.reference_id, r.n) for r in counted.collect()))  # at most one row for each entry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolver = resolver_of(entries, named)
        for batch in batches:
            refs = [resolver.resolve(f, v) for f, v in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(refs, pa.int32())], names=["skill_id", "field", "pos", "value", "reference_id"])

    kind = skills.schema["skill_id"].dataType.simpleString()
    return values.mapInArrow(run, f"skill_id {kind}, field string, pos int, value string, reference_id int")


def map_values(skills: DataFrame, reference: DataFrame) -> DataFrame:
    """(skill_id, field, pos, reference_id) for every value that holds more than blanks and commas."""
    return resolved_values(skills, reference).drop("value")
