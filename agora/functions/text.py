"""Text functions as Column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

#: Topics in the order in which they are tried, each with the substrings that name it.
TOPICS = {
    "Bylaw": ["bylaw", "zoning", "rezoning", "regulatory", "legislat"],
    "Development": ["develop", "planning", "land use", "permit", "ocp", "housing", "heritage", "subdivis"],
    "Environment": ["environ", "park", "climate", "sustain", "trail", "tree", "conservation", "recreation"],
    "Finance": ["financ", "budget", "tax", "grant", "capital", "debt", "fund"],
    "Transportation": ["transport", "traffic", "road", "transit", "cycl", "pedestr", "infrastruc", "engineer"],
    "Public Safety": ["safe", "polic", "fire", "protect", "emergency", "rcmp", "enforcement"],
    "Administration": ["admin", "governance", "appoint", "committee", "procedur", "minutes", "agenda", "adjournm", "closed", "routine", "consent"],
}
#: What each result is called in lists of motions.
RESULTS = {
    "CARRIED": "passed", "PASSED": "passed", "CARRIED UNANIMOUSLY": "passed", "CARRIED AS AMENDED": "passed", "CARRIED (AS AMENDED)": "passed", "AMENDED": "passed", "CARRRIED": "passed",
    "DEFEATED": "failed", "FAILED": "failed", "NOT CARRIED": "failed", "FAILED FOR LACK OF A SECONDER": "failed", "FAILED FOR LACK OF SECONDER": "failed",
    "TABLED": "tabled", "WITHDRAWN": "withdrawn",
}
#: Street kinds in short and in full.
STREETS = {"st": "street", "ave": "avenue", "rd": "road", "dr": "drive", "blvd": "boulevard", "cres": "crescent", "pl": "place", "crt": "court", "ln": "lane", "hwy": "highway", "pkwy": "parkway"}
#: Words that a shortened slug doesn't end with.
DANGLING = ["and", "or", "of", "the", "to", "for", "a", "an", "in", "on", "at", "with", "by", "from"]
#: First words, and first two words, of a question.
ASKING = ["who", "what", "when", "where", "why", "how", "is", "are", "was", "were", "do", "does", "did", "can", "could", "will", "would", "should", "has", "have", "tell me", "explain", "describe", "compare"]
#: The pattern of a stage that a title ends with, and what is trimmed where it was.
STAGE = (
    r"(?i)\s*[-–—(]?\s*\b(?:(?:first|second|third|1st|2nd|3rd)(?:\s*(?:,|and|&)\s*(?:first|second|third|1st|2nd|3rd))*\s+readings?"
    r"|readings?|adoption|final adoption|rescind(?:ing)? readings?|background report attached|all readings|for adoption)\b[^)]*\)?\s*$"
)
STAGE_ENDS = " -–—,"
#: The pattern of an amount, and words that turn or bound a decision.
AMOUNT = r"\$?\d[\d,]*(?:\.\d+)?%?"
TURNING = [
    "not", "no", "never", "without", "unless", "except", "against", "deny", "refuse", "reject", "approve", "adopt", "receive", "authorize", "include",
    "exclude", "remove", "reduce", "increase", "amend", "delete", "retain", "proceed", "defer", "table", "refer", "rescind", "waive", "terminate",
]


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is computed once, however often it is used."""
    return F.transform(F.array(value), of)[0]


def topic(category: ColumnOrName) -> Column:
    """The first topic of which the category has a substring; General without any, and for null."""
    text = F.lower(col(category))
    out = F.when(col(category).isNull(), "General")
    for name, parts in TOPICS.items():
        found = text.contains(parts[0])
        for p in parts[1:]:
            found |= text.contains(p)
        out = out.when(found, name)
    return out.otherwise("General")


def slug(text: ColumnOrName, size: int = 80) -> Column:
    """Lower case, runs of other characters than letters and digits as one hyphen, none at the ends, cut to a size."""
    return F.substring(F.regexp_replace(F.lower(F.regexp_replace(F.trim(col(text)), "[^a-zA-Z0-9]+", "-")), "^-+|-+$", ""), 1, size)


def slug_capped(text: ColumnOrName, size: int = 60) -> Column:
    """A slug of at most so many characters: a longer one is cut between words and doesn't end with connectives."""
    whole = slug(text, 1000)
    head = F.substring(whole, 1, size)
    cut = F.when(F.substring(whole, size + 1, 1) != "-", F.regexp_replace(head, "(?<=.)-[^-]*$", "")).otherwise(head)
    cut = F.trim(F.regexp_replace(cut, "(-(" + "|".join(DANGLING) + "))+$", ""), F.lit("-"))
    return F.when(F.length(whole) <= size, whole).otherwise(cut)


def motion_result(result: ColumnOrName) -> Column:
    """passed, failed, tabled, withdrawn, or null."""
    return F.create_map(*[F.lit(x) for pair in RESULTS.items() for x in pair])[F.upper(F.trim(col(result)))]


def outcome_family(result: ColumnOrName) -> Column:
    text = F.lower(F.trim(col(result)))
    return F.when(text.rlike("^(carried|passed|carrried)"), "carried").when(text.rlike("^(defeated|failed|not carried)"), "defeated").otherwise(text)


def question_key(text: ColumnOrName) -> Column:
    """Lower case, quotes dropped, all else but letters and digits as one space."""
    bare = F.regexp_replace(F.lower(col(text)), "['\"’‘“”]", "")
    return F.trim(F.regexp_replace(bare, "[^\\p{L}\\p{N}]+", " "))


def intent(text: ColumnOrName) -> Column:
    """question or keyword: a question ends with its mark, begins with an asking word, or has four words or more."""
    t = F.lower(F.trim(col(text)))
    phrases = [x for x in ASKING if " " in x]
    words = F.split(t, "\\s+")
    asks = t.endswith("?") | words[0].isin([x for x in ASKING if " " not in x]) | (F.size(words) >= 4)
    for x in phrases:
        asks |= (t == x) | t.startswith(f"{x} ")
    return F.when(asks, "question").otherwise("keyword")


def bylaw_numbers(text: ColumnOrName) -> Column:
    """Distinct numbers after the word bylaw, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit(r"by-?law\s*(?:no\.?|number|#)?\s*(\d{1,5})"), 1)))


def identifier(text: ColumnOrName) -> Column:
    """A bylaw, rezoning, permit or file number in one spelling; null without one."""
    t = F.upper(F.trim(col(text)))
    number = lambda p: F.regexp_extract(t, p, 1)
    return (
        F.when(t.rlike(r"BY-?LAW\s*(?:NO\.?|NUMBER|#)?\s*\d+"), F.concat(F.lit("bylaw-"), number(r"BY-?LAW\s*(?:NO\.?|NUMBER|#)?\s*(\d+)")))
        .when(t.rlike(r"^(REZ|TUP|DVP|DP)[ -]?\d+"), F.lower(F.concat(number(r"^(REZ|TUP|DVP|DP)"), F.lit("-"), F.regexp_extract(t, r"^(?:REZ|TUP|DVP|DP)[ -]?(\d+(?:-\d+)?)", 1))))
        .when(t.rlike(r"^\d{4}-\d+"), number(r"^(\d{4}-\d+)"))
    )


def address(text: ColumnOrName) -> Column:
    """Lower case, one space, street kinds in full."""
    out = F.regexp_replace(F.lower(F.trim(F.regexp_replace(col(text), "[.,]", " "))), "\\s+", " ")
    for short, long in STREETS.items():
        out = F.regexp_replace(out, f"\\b{short}\\b", long)
    return out


def strip_stage(title: ColumnOrName) -> Column:
    """A title without the readings or stages that it ends with, up to three; none goes that would leave under six characters."""

    def once(out: Column, _: Column) -> Column:
        return let(F.trim(F.regexp_replace(out, STAGE, ""), F.lit(STAGE_ENDS)), lambda less: F.when(F.length(less) < 6, out).otherwise(less))

    return F.aggregate(F.array(*[F.lit(k) for k in range(3)]), F.trim(F.coalesce(col(title), F.lit(""))), once)


def one_edit(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.levenshtein(col(a), col(b), 1).between(0, 1)


def scrub(text: ColumnOrName) -> Column:
    """Without mail addresses, telephone numbers and house numbers."""
    omitted = "[contact omitted]"
    out = F.regexp_replace(col(text), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", omitted)
    out = F.regexp_replace(out, r"(\+?1[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}", omitted)
    return F.regexp_replace(out, r"\b\d{1,5}\s+(?=[A-Z][a-z]+ (Street|Avenue|Road|Drive|Lane|Place|Way)\b)", "")


def clock(seconds: ColumnOrName) -> Column:
    """H:MM:SS."""
    s = F.floor(col(seconds)).cast("long")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def natural_key(text: ColumnOrName) -> Column:
    """Sorts numbers inside text by value: the length of a run of digits comes before it."""
    parts = F.regexp_extract_all(F.lower(col(text)), F.lit(r"(\d+|\D+)"), 1)
    bare = lambda x: F.regexp_replace(x, "^0+(?=\\d)", "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^\\d"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 6, "0"), bare(x))).otherwise(x)), "")


def token_estimate(text: ColumnOrName) -> Column:
    words = F.size(F.filter(F.split(F.coalesce(col(text), F.lit("")), "\\s+"), lambda x: x != ""))
    return F.floor(words * 1.3).cast("long")


def motion_words(text: ColumnOrName) -> Column:
    """Lower case, all else but letters a-z and digits as one space; THAT is parted from the Council or Committee it ran into."""
    apart = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?i)\bTHAT(?=(?:Council|Committee)\b)", "THAT ")
    return F.trim(F.regexp_replace(F.lower(apart), "[^a-z0-9]+", " "))


def polarity(text: ColumnOrName) -> Column:
    """Amounts of a motion in order, a bar, and its turning words by alphabet: what two wordings of it must share."""
    amounts = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(f"({AMOUNT})"), 1)
    turning = F.array_sort(F.filter(F.split(motion_words(text), " "), lambda w: w.isin(TURNING)))
    return F.concat_ws(" ", F.array_join(amounts, " "), F.lit("|"), F.array_join(turning, " "))


def uuid5(namespace: str, name: ColumnOrName) -> Column:
    """RFC 4122 version 5 id of a name in a namespace (32 hex digits with hyphens)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(col(name), "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(nibble.bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def related_addresses(text: ColumnOrName) -> Column:
    """Addresses of a JSON array of strings, or the text itself as the only one; none for null or blank."""
    listed = F.from_json(col(text), "array<string>")
    plain = F.array(F.trim(col(text)))
    return F.when(col(text).isNull() | (F.trim(col(text)) == ""), F.array().cast("array<string>")).when(F.trim(col(text)).startswith("["), F.coalesce(listed, plain)).otherwise(plain)
