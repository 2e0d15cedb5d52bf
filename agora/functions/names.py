"""Names, spoken numbers, glossaries, evidence: text functions with more rules, as Column builders."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from agora.functions.text import ColumnOrName, col

#: What a list of names may hold beside names; honours before and after names.
NOT_NAMES = [
    "the mayor", "staff", "resident", "unknown", "speaker", "everyone", "all council", "public", "audience", "applicant", "consultant", "gallery", "various",
    "multiple", "unidentified", "city staff", "town staff", "clerk", "recording secretary", "moderator", "presenter", "developer", "architect", "engineer", "planner",
]
HONOURS = ["mayor", "acting mayor", "councillor", "councilor", "chair", "director", "mr", "mrs", "ms", "dr"]
#: Number words, as they are spoken in meetings.
NUMBERS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
}


def valid_name(name: ColumnOrName) -> Column:
    """A person's name: three characters or more, no digit, and none of the words that lists also hold, alone or in front."""
    n = F.lower(F.trim(col(name)))
    return F.coalesce((F.length(n) >= 3) & ~n.rlike("\\p{Nd}") & ~n.rlike("^(?:" + "|".join(NOT_NAMES) + ")(?: |$)"), F.lit(False))


def clean_name(name: ColumnOrName) -> Column:
    """Without honours, bracketed additions and more than single spaces."""
    out = F.regexp_replace(col(name), "\\s*\\([^)]*\\)", "")
    out = F.regexp_replace(out, "(?i)^\\s*((" + "|".join(sorted(HONOURS, key=len, reverse=True)) + ")\\.?\\s+)+", "")
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def plain_letters() -> tuple[str, str]:
    """Latin letters with marks, and the letters without."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def name_words(name: ColumnOrName) -> Column:
    """The words of a name in lower case without marks; apostrophes and hyphens inside a word stay."""
    bare = F.regexp_replace(F.translate(F.lower(col(name)), *plain_letters()), "\\p{M}", "")
    return F.regexp_extract_all(bare, F.lit("([a-z]+(?:['’-][a-z]+)*)"), 1)


def name_score(a: ColumnOrName, b: ColumnOrName) -> Column:
    """How surely two spellings, of equally many words, two at least, are one name; 0 if they may be two.

    1 equal; .96 one edit in the last word, of five letters or more; .94 one in the first, of four or more; .92 an initial
    for the first. All other words are equal.
    """
    x, y = name_words(a), name_words(b)
    n = F.size(x)
    first, last = (lambda w: w[0]), (lambda w: F.element_at(w, -1))
    same_rest, same_start = F.slice(x, F.lit(2), n) == F.slice(y, F.lit(2), n), F.slice(x, F.lit(1), n - 1) == F.slice(y, F.lit(1), n - 1)
    near = lambda p, q, least: (F.least(F.length(p), F.length(q)) >= least) & F.levenshtein(p, q, 1).between(0, 1)
    initial = (F.least(F.length(first(x)), F.length(first(y))) == 1) & (F.substring(first(x), 1, 1) == F.substring(first(y), 1, 1))
    score = F.when(x == y, 1.0).when(same_rest & initial, 0.92).when(same_start & near(last(x), last(y), 5), 0.96).when(same_rest & near(first(x), first(y), 4), 0.94).otherwise(0.0)
    return F.when((n >= 2) & (n == F.size(y)), score).otherwise(0.0)


NUMBER_WORD = "(?:" + "|".join(sorted(NUMBERS, key=len, reverse=True)) + ")"
#: A run of number words, another word, or one other character: all of a text, in order.
PIECE = rf"\b{NUMBER_WORD}(?:[\s-]+{NUMBER_WORD})*\b|\w+|\W"


def spoken_numbers(text: ColumnOrName) -> Column:
    """A text as it is compared with speech: lower case, numbers in figures, spoken decimals joined, punctuation out.

    "twenty-three" is 23, a run of digits one number ("two one seven zero" is 2170), "eight point one point one" is 8.1.1.
    """
    value = F.create_map(*[x for word, n in NUMBERS.items() for x in (F.lit(word), F.lit(n))])

    def add(said: Column, n: Column) -> Column:
        last = F.regexp_extract(said, r"(\d+)$", 1)
        open_ = (last != "") & (last.cast("int") >= 20) & (last.cast("int") % 10 == 0) & (n < 10)
        return F.when(open_, F.concat(F.regexp_replace(said, r"\d+$", ""), (last.cast("int") + n).cast("string"))).otherwise(F.concat_ws(" ", F.when(said != "", said), n.cast("string")))

    def figures(run: Column) -> Column:
        values = F.transform(F.split(run, r"[\s-]+"), lambda w: F.element_at(value, w))
        digits = (F.size(values) > 1) & F.forall(values, lambda n: n < 10)
        return F.when(digits, F.array_join(F.transform(values, lambda n: n.cast("string")), "")).otherwise(F.aggregate(values, F.lit(""), add))

    low = F.replace(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("\u2019"), F.lit("'"))
    pieces = F.regexp_extract_all(low, F.lit(f"(?U)({PIECE})"), 1)
    out = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(f"^{NUMBER_WORD}(?![a-z0-9_])"), figures(x)).otherwise(x)), "")
    for pattern, joined in ((r"\b(\d+)\s+point\s+(\d+)\b", "$1.$2"),) * 2 + ((r"\b(\d+(?:\.\d+)+)\s+point\s+(\d+)\b", "$1.$2"), (r"(\d)\s*\.\s+(\d)", "$1.$2"), (r"[^a-z0-9.'\s-]", " "), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, joined)
    return F.trim(out)


def glossary(text: ColumnOrName, corrections: Mapping[str, str]) -> Column:
    """Whole words corrected in the glossary's order, each seeing what the ones before it left; capitals are kept."""
    out = col(text)
    for wrong, right in corrections.items():
        for a, b in ((wrong.upper(), right.upper()), (wrong.capitalize(), right.capitalize()), (wrong, right)):
            out = F.regexp_replace(out, f"\\b{a}\\b", b)
    return out


class WordRuns:
    """All runs of a text's words as a suffix automaton: a state for each set of places where a run ends."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, last = [-1], [0], 0
        for word in words:
            new = self.state({}, self.size[last] + 1)
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at < 0:
                self.link[new] = 0
            elif self.size[to := self.next[at][word]] == self.size[at] + 1:
                self.link[new] = to
            else:
                copy = self.state(dict(self.next[to]), self.size[at] + 1, self.link[to])
                while at >= 0 and self.next[at].get(word) == to:
                    self.next[at][word] = copy
                    at = self.link[at]
                self.link[to] = self.link[new] = copy
            last = new

    def state(self, following: dict[str, int], size: int, link: int = -1) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        return len(self.link) - 1

    def longest(self, words: list[str], least: int) -> int:
        """Characters of the longest run of ``words``, of ``least`` or more, that the text has, too."""
        ends = [0]
        for w in words:
            ends.append(ends[-1] + len(w) + 1)
        at, run, best = 0, 0, 0
        for k, word in enumerate(words, 1):
            while at and word not in self.next[at]:
                at = self.link[at]
                run = self.size[at]
            if word in self.next[at]:
                at, run = self.next[at][word], run + 1
            if run >= least:
                best = max(best, ends[k] - ends[k - run] - 1)
        return best


def common_sequence(a: ColumnOrName, b: ColumnOrName, least: int = 3) -> Column:
    """Characters of the longest sequence of words, ``least`` or more, that both texts have; capitals count; 0 for null.

    In time linear in both texts; a text on the right that comes several times in a batch is worked up once.
    """

    @F.pandas_udf("int")
    def longest(x: pd.Series, y: pd.Series) -> pd.Series:
        made: dict[str, WordRuns] = {}
        out = []
        for p, q in zip(x, y, strict=True):
            q = q or ""
            if q not in made:
                if len(made) >= 64:
                    made.clear()
                made[q] = WordRuns(q.split())
            out.append(made[q].longest((p or "").split(), least))
        return pd.Series(out, dtype="int32")

    return longest(col(a), col(b))


def matter_slug(ident: ColumnOrName, title: ColumnOrName, row_id: ColumnOrName) -> Column:
    """Identifier and title as a slug; one of digits alone, or none, gets its id."""
    from agora.functions.text import slug_capped

    base = slug_capped(F.concat_ws(" ", col(ident), col(title)))
    return F.when(F.coalesce(base, F.lit("")) == "", F.concat(F.lit("matter-"), col(row_id).cast("string"))).when(base.rlike("^\\d+$"), F.concat(F.lit("matter-"), base)).otherwise(base)


EVIDENCE = "schema string, method string, state string, person_id long, meeting_id long, source_url string, source_sha256 string, source_page int, source_quote string, local_date string"


def attendance_evidence(notes: ColumnOrName, person_id: ColumnOrName, meeting_id: ColumnOrName, day: ColumnOrName, schema: str, methods: Sequence[str], mode: ColumnOrName, legacy: tuple[str, str]) -> Column:
    """state and verified of an attendance row.

    Valid evidence (typed JSON, all of its fields in form) of the meeting's day gives its state, verified; of another day,
    unknown. Without any, blank notes of a day in the legacy range go by the attendance mode; all else is unknown.
    """
    e = F.from_json(col(notes), EVIDENCE)
    valid = (
        (e["schema"] == schema)
        & e["method"].isin(list(methods))
        & e["state"].isin("present", "absent")
        & (e["person_id"] == col(person_id))
        & (e["meeting_id"] == col(meeting_id))
        & e["source_url"].rlike("^https://[^\\s]+$")
        & e["source_sha256"].rlike("^[0-9a-f]{64}$")
        & (e["source_page"] >= 1)
        & (F.trim(e["source_quote"]) != "")
    )
    valid = F.coalesce(valid, F.lit(False))
    on_day = F.coalesce(F.try_to_date(e["local_date"], "yyyy-MM-dd") == col(day), F.lit(False))
    blank = F.trim(F.coalesce(col(notes), F.lit(""))) == ""
    old = blank & col(day).between(F.lit(legacy[0]).cast("date"), F.lit(legacy[1]).cast("date"))
    by_mode = F.when(col(mode) == "In Person", "present").when(col(mode).isin("Absent", "Regrets"), "absent").otherwise("unknown")
    state = F.when(valid & on_day, e["state"]).when(~valid & old, by_mode).otherwise("unknown")
    return F.struct(state.alias("state"), (valid & on_day).alias("verified"))


def key_vote_sentence(name: ColumnOrName, vote: ColumnOrName, title: ColumnOrName, split: ColumnOrName, kinds: ColumnOrName) -> Column:
    """What made a vote stand out, as a sentence."""
    why = F.when(col(kinds).contains("minority"), "against the majority").when(col(kinds).contains("close_vote"), "in a close vote").otherwise("apart from a usual ally")
    return F.concat(col(name), F.lit(" voted "), col(vote), F.lit(" on "), col(title), F.lit(" "), why, F.lit(" ("), col(split), F.lit(")"))
