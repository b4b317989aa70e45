"""The licence of every repository and file, from grammars over comment text.

A comment text is read completely, as a sequence of notices, labels, statements, titles and other prose.

Notices are templates compiled into grammars over words: a word, an optional word (an article), or a replaceable section
(what a notice calls the thing it covers). A grammar that matches as it stands is found by backtracking; else the notice
is aligned with the words of the text, at most one edit (a word put in, left out or exchanged) for every `WORDS_AN_EDIT`
words of the template. What a notice covers is taken out of the text before the rest is read.

The rest is cut into clauses. A clause states a licence if it is, as a whole, a label with names ("SPDX-License-Identifier:
..."), a name on its own, names with a verb of force ("today the ... does"), or a subject, a verb of licensing, a link
("under", "governed by" ...) and names. The subject, verb and adverbs before the link decide about scope and tense: a
clause that is negated, conditional or past, or whose subject is another thing than the file (an indefinite thing, or one
that a relative clause speaks of), states nothing. Names are read by the resolver of typed values: the longest reading
without a slip, else the longest within its slips.

Defined results: null and empty texts state nothing; a licence stated several times counts once; rows repeated verbatim
count once; a file of an unknown skill or repository has no enclosing licence and the flag unknown; empty tables give no
rows. License choices are sorted and joined by " OR ".
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm import names

FIELD = "declared_license"
WORDS_AN_EDIT = 10
_MARKS = re.compile(r"^[ \t]*(?:#!.*$|/\*+|\*+/|<!--+|--+>|\*(?!\w)|//+|#+|--+|;+|%+|\"\"\"|''')?[ \t]*")
_TAIL = re.compile(r"[ \t]*(?:\*+/|--+>|\"\"\"|''')[ \t]*$")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_HINT = re.compile(r"licen[cs]|spdx|under|govern|cover|subject|today|now|since|appl|terms")
_LETTERS = re.compile(r"[\W_]+")
#: A replaceable section: what a notice calls the thing it covers.
_THING = r"(?:this (?:work|software|program|code|file|library|package|project|module|material)|(?:the|our) (?:\w+ ){0,3}?(?:files|file|work|software|program|code|library|package|project|module|material)|these files)"
_COVERED = re.compile(rf"\b{_THING}\b")
#: Optional words of a notice.
ARTICLES = frozenset(("the", "a", "an"))

_LABEL = re.compile(r"(?:spdx[-\s]+licen[cs]e[-\s]+identifier[ \t]*:?|@licen[cs]e\b[ \t]*:?|licen[cs]es?[ \t]*(?:[:=]|[-–—](?=\s)))[ \t]*")
_LABEL_LINE = re.compile(rf"^[ \t]*(?={_LABEL.pattern})", re.I | re.M)
#: Where a clause ends: an end mark or semicolon before white space, a blank line, before a label, before a line that starts with a verb of licensing.
_CLAUSE = re.compile(r"[.!?;](?=\s|$)|\n[ \t]*\n|\n(?=[ \t]*(?:Licen[cs]ed|Released|Distributed|Published|Dual|Multi|Copyright)\b)")
_TERMS = r"(?:(?:the\s+)?(?:same\s+)?terms(?:\s+and\s+conditions)?\s+of\s+)?(?P<either>either\s+(?:of\s+)?)?(?:the\s+)?"
_LINK = re.compile(rf"\b(?:under|(?:governed|covered)\s+by|subject\s+to|in\s+accordance\s+with|according\s+to)\s+{_TERMS}")
_DUAL = re.compile(r"\b(?:dual|double|multi|triple)[-\s]+licen[cs]ed\b[^:\n]*?:\s*(?:the\s+)?")
_IN_FORCE = re.compile(r"(?:(?:today|now|currently|at present|since\s+\d{4}|from\s+\d{4}(?:\s+on)?)\b,?\s*)?(?:the\s+)?")
_FORCE = re.compile(r"\s*(?:does|applies|holds|governs|covers|is\s+in\s+force)\b(?!\s+(?:not|no)\b)")
_OR = re.compile(r"\s*(?:,?\s*\bor\b|/|\|\|?|,)\s*(?:the\s+)?")
_AND = re.compile(r"\s*(?:,?\s*\band\b|&|\+)\s*(?:the\s+)?")
_PIECE = re.compile(r"\s*[(\[]?[^\W_][^\s;()\[\]]*[)\]]?,?")
_ENDS = re.compile(r"(?:[.!?:]|\))$")
_INNER_DOT = re.compile(r"\.(?=\w)")
_TOKEN = re.compile(r"[\w'’-]+")
# Closed classes of English words that decide about a clause before its link.
#: Verbs of licensing, by their stems.
_VERB = re.compile(r"^(?:licen[cs]|sublicen[cs]|releas|distribut|redistribut|availab|publish|provid|offer|free|govern|cover|us(?:e|ed|es|able|age)$|ship|subject|permit|allow|cop(?:y|ied|ies)$|shar(?:e|ed)$|grant|plac|put$|fall|remain|stay|come|modif|contribut|dual|multi)")
NEGATED = frozenset("not no never nor neither cannot nobody nothing none without unlike except don't doesn't isn't aren't won't don’t doesn’t isn’t aren’t".split())
CONDITIONAL = frozenset("if unless whether would could should might were".split())
PAST = frozenset("was were had until before formerly previously once originally earlier ago".split())
RELATIVE = frozenset("that which who whose where".split())
#: Determiners of things other than the file itself.
OTHER = frozenset("a an another other others some any each every their its his her upstream".split())
OWN = frozenset("this these the our all".split())
#: What a bare title within slips of a name has at least.
_TITLE_HINT = re.compile(r"lic|ice|cen|ens|nse|comm|attr")


def comment_text(text: str) -> str:
    """The text without comment marks; a line that starts or ends a comment loses them, other lines stay whole."""
    lines = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return "\n".join(_TAIL.sub("", _MARKS.sub("", line)).strip() for line in lines)


def own_and_in_force(clause: str) -> bool:
    """Whether the words before a link speak of the file itself, as something that holds now."""
    found = _TOKEN.findall(clause)
    if any(w in NEGATED or w in CONDITIONAL or w in PAST for w in found):
        return False
    if not found:
        return True
    if not any(_VERB.match(w) for w in found) and found[-1] not in ("is", "are", "now"):
        return False
    for i, w in enumerate(found):
        if w in RELATIVE:
            # the relative clause speaks of what its nearest determiner stands before
            for x in reversed(found[:i]):
                if x in OTHER:
                    return False
                if x in OWN:
                    break
    return found[0] not in OTHER


class Notice:
    """A notice as a grammar over words."""

    def __init__(self, canonical: str, notice: str):
        self.canonical = canonical
        text = " ".join(_WORD.findall(unicodedata.normalize("NFKC", notice).lower()))
        self.items = _COVERED.sub("\u0000", text).split()
        parts = [rf"(?:{regex.escape(w)} )?" if w in ARTICLES else r"\u0000 " if w == "\u0000" else regex.escape(w) + " " for w in self.items]
        self.exact = regex.compile(r"(?<!\S)" + "".join(parts))
        self.edits = len(self.items) // WORDS_AN_EDIT
        pairs = set(zip(self.items, self.items[1:], strict=False))
        self.pairs, self.needed = pairs, max(1, len(pairs) - 2 * self.edits - sum(w in ARTICLES for w in self.items))

    def find(self, found: list[str], joined: str) -> tuple[int, int] | None:
        """(first, end) of the words that the notice covers, in a text that has `needed` of its pairs of words."""
        m = self.exact.search(joined)
        if m:
            first = joined.count(" ", 0, m.start())
            return first, first + m.group().count(" ")
        if not self.edits:
            return None
        # alignment with free ends; each cell is (edits, where the match began)
        row = [(0, j) for j in range(len(found) + 1)]
        for w in self.items:
            free = w in ARTICLES
            last, row = row, [(row[0][0] + (not free), 0)]
            for j, x in enumerate(found, 1):
                best = (last[j - 1][0] + (w != x), last[j - 1][1])
                best = min(best, (last[j][0] + (not free), last[j][1]), (row[j - 1][0] + (x not in ARTICLES), row[j - 1][1]))
                row.append(best)
        edits, end = min((c[0], j) for j, c in enumerate(row))
        return (row[end][1], end) if edits <= self.edits else None


class Grammar:
    def __init__(self, entries: list[tuple[int, str, str, str | None]], notices: list[tuple[str, str]]):
        self.resolver = names.Resolver([e for e in entries if e[1] == FIELD])
        self.canonical = {e[0]: e[2] for e in entries if e[1] == FIELD}
        self.by_key = {c.strip().casefold(): c for c in self.canonical.values()}
        self.notices = [Notice(c, t) for c, t in notices if t and t.strip()]
        self.with_pair: dict[tuple[str, str], list[int]] = {}
        for k, notice in enumerate(self.notices):
            for pair in notice.pairs:
                self.with_pair.setdefault(pair, []).append(k)
        #: No name has more letters than the longest form and its slips.
        self.longest = max((len(form) for _, form in self.resolver.exact), default=0) + names.SLIPS + len("the") + max(map(len, names.AFTER_VERSION)) + len("license")
        self.near = lru_cache(100_000)(self._near)
        self.stated = lru_cache(20_000)(self._stated)

    def entry(self, value: str | None) -> str | None:
        """The entry of a license_spdx_id, letter case and blanks aside."""
        return self.by_key.get(value.strip().casefold()) if value else None

    def declared(self, value: str | None) -> str | None:
        if not value or not value.strip(" ,\t\r\n"):
            return None
        return self.canonical.get(self.resolver.resolve(FIELD, value))

    def _named(self, key: str) -> str | None:
        """The licence whose form a squeezed text is, without a slip."""
        found = self.resolver.exact
        return self.canonical.get(found.get((FIELD, key), 0) or found.get((FIELD, names.bare(key)), 0))

    def _near(self, key: str) -> str | None:
        near = self.resolver.slipped(FIELD, key)
        return self.canonical.get(near[3]) if near else None

    def read(self, text: str, at: int, slips: bool = True) -> tuple[str, int] | None:
        """The licence named by the words of text from a place on, with slips or without, and where its name ends."""
        keys, key = [], ""
        while len(key) <= self.longest:
            m = _PIECE.match(text, at)
            if not m:
                break
            piece = m.group().rstrip()
            at = m.end()
            key = (key + _LETTERS.sub("", piece)).replace("licence", "license")
            keys.append((key.removeprefix("the"), at - len(piece) + len(piece.rstrip(",."))))
            if _ENDS.search(piece):
                break
        for key, end in reversed(keys):
            if found := self._named(key):
                return found, end
        for key, end in reversed(keys if slips else []):
            if found := self.near(key):
                return found, end
        return None

    def _names(self, text: str, at: int) -> tuple[list[str], bool, int]:
        """(names, whether a choice, end) of NAME ((or | and) NAME)* at a place in text."""
        while at < len(text) and text[at] in " \t\n(":
            at += 1
        first = self.read(text, at)
        if not first:
            return [], False, at
        found, choice, end = [first[0]], False, first[1]
        while True:
            for pattern, is_choice in ((_OR, True), (_AND, False)):
                m = pattern.match(text, end)
                more = m and self.read(text, m.end())
                if more:
                    found.append(more[0])
                    choice |= is_choice
                    end = more[1]
                    break
            else:
                return found, choice, end

    def _notices(self, body: str, plain: set[str]) -> str:
        """body without the notices in it, whose licences are added to plain."""
        while True:
            spans = [m.span() for m in _WORD.finditer(body)]
            low = [body[a:b].lower() for a, b in spans]
            if not any(pair in self.with_pair for pair in zip(low, low[1:], strict=False)):
                return body
            # a replaceable section is one word
            text = " ".join(low) + " "
            found, where, at, k = [], [], 0, 0
            for m in _COVERED.finditer(text):
                n = text.count(" ", at, m.start())
                found += low[k : k + n]
                where += range(k, k + n)
                k += n
                size = m.group().count(" ") + 1
                found.append("\u0000")
                where.append(k)
                k += size
                at = m.end() + 1
            found += low[k:]
            where += range(k, len(low))
            where.append(len(low))
            held = Counter(k for pair in set(zip(found, found[1:], strict=False)) for k in self.with_pair.get(pair, ()))
            likely = [self.notices[k] for k, n in held.most_common() if n >= self.notices[k].needed]
            joined = "".join(w + " " for w in found) if likely else ""
            for notice in likely:
                hit = notice.find(found, joined)
                if hit and hit[1] > hit[0]:
                    plain.add(notice.canonical)
                    first, last = where[hit[0]], where[hit[1]] - 1
                    body = body[: spans[first][0]] + "\n\n" + body[spans[last][1] :]
                    break
            else:
                return body

    def _clause(self, text: str) -> list[tuple[list[str], bool]]:
        """[(names, whether a choice)] that a clause, in lower case, states."""
        text = text.strip()
        if not text:
            return []
        label = _LABEL.match(text)
        if label:
            end = label.end()
            if end >= len(text) or text[end] == "\n":
                return []
            found, choice, end = self._names(text, end)
            # what follows the names is a clause of its own
            return [*([(found, choice)] if found else []), *self._clause(text[end:].lstrip(" \t,)]") if found else text[end:].partition("\n")[2])]
        if dual := _DUAL.search(text):
            found, choice, _ = self._names(text, dual.end())
            return [(found, True)] if found and own_and_in_force(text[: dual.start()] + " licensed") else []
        out, start = [], 0
        for link in _LINK.finditer(text):
            before = text[start : link.start()] + (" " + link.group().split()[0] if not link.group().startswith("under") else "")
            found, choice, end = self._names(text, link.end())
            if found and own_and_in_force(before):
                out.append((found, choice or bool(link.group("either"))))
                start = end
        if not out:
            # without a word for now, the subject of any sentence stands here: only a name without a slip is one
            since = _IN_FORCE.match(text)
            adverb = since.group().strip() not in ("", "the")
            found, choice, end = self._names(text, since.end()) if adverb or self.read(text, since.end(), False) else ([], False, 0)
            if found and _FORCE.match(text, end):
                out.append((found, choice))
        return out

    def _stated(self, text: str) -> tuple[frozenset, frozenset]:
        """(licences stated, licences of a choice) of a header or licence file."""
        plain: set[str] = set()
        choices: set[str] = set()
        body = self._notices(comment_text(text), plain)
        body = _INNER_DOT.sub("\u00b7", body)
        if _HINT.search(body.lower()):
            for part in _LABEL_LINE.sub("\u0000", body).split("\u0000"):
                for clause in _CLAUSE.split(part):
                    for found, choice in self._clause(clause.lower()):
                        (choices if choice and len(set(found)) > 1 else plain).update(found)
        for line in body.lower().split("\n"):
            key = _LETTERS.sub("", line).replace("licence", "license").removeprefix("the") if ":" not in line else ""
            if 2 < len(key) <= self.longest and (named := self._named(key) or (_TITLE_HINT.search(key) and self.near(key))):
                plain.add(named)
        return frozenset(plain), frozenset(choices)


@lru_cache(4)
def grammar_of(entries: tuple, notices: tuple) -> Grammar:
    """The grammar of a list; a Python worker keeps it from task to task."""
    return Grammar(list(entries), list(notices))


def verdict(plain: frozenset, choices: frozenset, enclosing: str | None, repository_flag: str) -> tuple[str, str]:
    """(license, flag) of a file whose header states plain licences and those of a choice."""
    if choices and plain <= choices:
        return " OR ".join(sorted(choices)), "conflict" if enclosing and enclosing not in choices else "ok"
    stated = plain | choices
    if len(stated) > 1:
        return "NONE", "conflict"
    if stated:
        (one,) = stated
        return one, "conflict" if enclosing and enclosing != one else "ok"
    return (enclosing, "ok") if enclosing else ("NONE", repository_flag)


def decide(repositories: DataFrame, skills: DataFrame, skill_files: DataFrame, reference: DataFrame) -> DataFrame:
    """(scope, subject_id, license, flag) for every repository and every file of a skill."""
    entries = tuple(sorted(names.entries_of(reference)))
    notices = tuple(sorted((r[0], r[1]) for r in reference.where("field = 'declared_license' AND notice_text IS NOT NULL").select("canonical_value", "notice_text").distinct().collect()))

    def grammar() -> Grammar:
        return grammar_of(entries, notices)

    repos = names.latest(repositories, "github_repository_id", "fetched_at", ["license_spdx_id"])
    files = names.latest(skill_files, "file_id", "listed_at", ["skill_id", "repository_id", "header_text"])
    roots = files.where("skill_id IS NULL AND header_text IS NOT NULL").select("repository_id", "header_text").distinct()

    def read_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammar()
        for batch in batches:
            stated = [sorted(a | b) for a, b in map(g.stated, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stated, pa.list_(pa.string()))], names=["repository_id", "stated"])

    def read_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammar()
        for batch in batches:
            stated = [[e] if (e := g.entry(v)) else [] for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stated, pa.list_(pa.string()))], names=["repository_id", "stated"])

    def read_declared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammar()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g.declared(v) for v in batch.column(1).to_pylist()], pa.string())], names=["skill_id", "declared"])

    shape = "repository_id bigint, stated array<string>"
    root_says = roots.mapInArrow(read_roots, shape)
    id_says = repos.select("github_repository_id", "license_spdx_id").mapInArrow(read_ids, shape)
    # a repository's evidence is at most the entries of the list, as each task keeps distinct licences
    evidence = (
        root_says.select("repository_id", F.explode("stated").alias("l"), F.lit(False).alias("own"))
        .unionByName(id_says.select("repository_id", F.explode_outer("stated").alias("l"), F.lit(True).alias("own")))
        .groupBy("repository_id")
        .agg(F.sort_array(F.collect_set("l")).alias("l"), F.max("own").alias("own"))
        .select(
            "repository_id",
            "own",
            F.when(F.size("l") == 1, F.col("l")[0]).otherwise("NONE").alias("license"),
            F.when(F.size("l") == 1, "ok").when(F.size("l") > 1, "conflict").otherwise("unknown").alias("flag"),
        )
    )
    declared = names.latest(skills, "skill_id", "last_seen_at", ["declared_license"]).mapInArrow(read_declared, "skill_id bigint, declared string")

    def read_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammar()
        for batch in batches:
            said = [g.stated(h) if h else (frozenset(), frozenset()) for h in batch.column(3).to_pylist()]
            lists = [pa.array([sorted(x[k]) for x in said], pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *lists], names=["file_id", "skill_id", "repository_id", "plain", "choices"])

    # headers are read where their rows are; only what they state meets the skills and repositories. The joins are by the skewed keys, of few bytes a row
    own = files.where("skill_id IS NOT NULL").select("file_id", "skill_id", "repository_id", "header_text")
    own = own.mapInArrow(read_headers, "file_id bigint, skill_id bigint, repository_id bigint, plain array<string>, choices array<string>")
    own = own.join(declared, "skill_id", "left").join(evidence.drop("own"), "repository_id", "left")
    enclosing = F.coalesce("declared", F.when(F.col("flag") == "ok", F.col("license")))
    stated = F.array_union("plain", "choices")
    offered = (F.size("choices") > 0) & (F.size(F.array_except("plain", "choices")) == 0)
    license_ = (
        F.when(offered, F.array_join(F.array_sort("choices"), " OR "))
        .when(F.size(stated) > 1, "NONE").when(F.size(stated) == 1, stated[0]).otherwise(F.coalesce(enclosing, F.lit("NONE")))
    )
    against = enclosing.isNotNull() & ~F.array_contains(F.when(offered, F.col("choices")).otherwise(stated), enclosing)
    flag = (
        F.when(~offered & (F.size(stated) > 1), "conflict").when(F.size(stated) >= 1, F.when(against, "conflict").otherwise("ok"))
        .otherwise(F.when(enclosing.isNotNull(), "ok").otherwise(F.coalesce("flag", F.lit("unknown"))))
    )
    of_files = own.select(F.col("file_id").alias("subject_id"), license_.alias("license"), flag.alias("flag"))
    of_repos = evidence.where("own").select(F.lit("repository").alias("scope"), F.col("repository_id").alias("subject_id"), "license", "flag")
    return of_repos.unionByName(of_files.select(F.lit("file").alias("scope"), "subject_id", "license", "flag"))
