"""Recognizers of personal data and credentials, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakloom.functions.spans import find_all

HITS = "array<struct<start:int,end:int,entity_type:string,score:double>>"


def _real_date(year: Column, month: Column, day: Column, as_of: Column) -> Column:
    """Whether there is such a day, not after ``as_of``."""
    date = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")
    return F.coalesce((year > 0) & (date <= as_of), F.lit(False))


def registration_date(value: Column, as_of: Column) -> Column:
    """The first six digits are a birthday in the century that the seventh names."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = lambda a, n: F.substring(digits, a, n).cast("int")
    century = F.when(F.substring(digits, 7, 1).isin("1", "2", "5", "6"), 1900).otherwise(2000)
    return _real_date(century + part(1, 2), part(3, 2), part(5, 2), as_of)


def calendar_date(value: Column, as_of: Column) -> Column:
    part = lambda k: F.element_at(F.split(value, "[-./]"), k).cast("int")
    return _real_date(part(1), part(2), part(3), as_of)


@dataclass(frozen=True)
class Recognizer:
    """A pattern with its checks. ``\\d`` and ``\\w`` are Unicode's.

    A match counts if the validator holds, if none of ``never`` stands in the 20
    characters before it and, where there are ``needs``, if one of them stands within 30
    characters around it. Contexts are found in the lowered text, as parts of words too.
    """

    entity_type: str
    pattern: str
    score: float
    validator: Callable[[Column, Column], Column] | None = None
    never: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()

    def hits(self, text: Column, as_of: Column) -> Column:
        low = F.lower(text)
        cut = lambda a, b: F.substring(low, F.greatest(a, F.lit(0)) + 1, b - F.greatest(a, F.lit(0)))

        def good(m: Column) -> Column:
            out = F.lit(True)
            if self.validator:
                out = out & self.validator(m["value"], as_of)
            for context in self.never:
                out = out & ~F.contains(cut(m["start"] - 20, m["start"]), F.lit(context.lower()))
            if self.needs:
                around = cut(m["start"] - 30, F.least(F.length(text), m["end"] + 30))
                found = F.lit(False)
                for context in self.needs:
                    found = found | F.contains(around, F.lit(context.lower()))
                out = out & found
            return out

        return _as_hits(F.filter(find_all(text, f"(?U){self.pattern}"), good), self.entity_type, self.score)


@dataclass(frozen=True)
class Rule:
    """A rule from a table: a pattern in any case, bound to a label before it where it needs one.

    Bound means that the 100 characters before the match end in a label, quoted or not,
    a colon or equals sign, and perhaps a quote. A rule that needs a label and has none
    never matches.
    """

    rule_id: str
    entity_type: str
    pattern: str
    score: float
    keywords: tuple[str, ...] = ()
    requires_context: bool = False

    def hits(self, text: Column, as_of: Column | None = None) -> Column:
        found = find_all(text, f"(?iuU){self.pattern}")
        if self.requires_context:
            labels = "|".join(re.escape(x) for x in sorted(self.keywords, key=len, reverse=True))
            bound = rf"(?iuU)[\"']?(?:{labels})[\"']?\s*(?::|=)\s*[\"']?\z"
            before = lambda m: F.substring(text, F.greatest(m["start"] - 100, F.lit(0)) + 1, F.least(m["start"], F.lit(100)))
            found = F.filter(found, (lambda m: before(m).rlike(bound)) if self.keywords else (lambda m: F.lit(False)))
        return _as_hits(found, self.entity_type, self.score)


def _as_hits(found: Column, entity_type: str, score: float) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(entity_type).alias("entity_type"), F.lit(score).alias("score")))


# The recognizers of personal data.
PERSONAL_DATA = (
    Recognizer("KR_RRN", r"(?<!\d)(\d{2})(\d{2})(\d{2})[- ]?([1-4])(\d{6})(?!\d)", 0.95, registration_date),
    Recognizer("KR_FOREIGN_REGISTRATION_NUMBER", r"(?<!\d)(\d{2})(\d{2})(\d{2})[- ]?([5-8])(\d{6})(?!\d)", 0.95, registration_date),
    Recognizer("KR_PHONE_NUMBER", r"(?<!\d)(?:010(?:[- .]?\d{4}){2}|\+82[- .]?10[- .]?\d{4}[- .]?\d{4})(?!\d)", 0.90, never=("문서번호", "사번", "계약번호", "문서 id", "문서id", "document id")),
    Recognizer("EMAIL_ADDRESS", r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9._%+-])", 0.90),
    Recognizer("KR_DATE_OF_BIRTH", r"(?<!\d)(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?!\d)", 0.85, calendar_date, ("계약일", "작성일", "발행일", "기준일"), ("생년월일", "생일", "출생일", "date of birth", "dob")),
)

#: Addresses as the SQL of the queries has them: whatever touches them, so also before a full stop and after letters beyond
#: ASCII, where ``PERSONAL_DATA`` sees none. What precedes the local part, or the match before, spares a second look at a run.
PLAIN_EMAIL = Recognizer("EMAIL_ADDRESS", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.90)
PLAIN_PERSONAL_DATA = tuple(PLAIN_EMAIL if r.entity_type == PLAIN_EMAIL.entity_type else r for r in PERSONAL_DATA)

# The patterns that a document's check counts, and the shape of a date, which is no account number.
CATALOGUE = {
    "주민등록번호": r"\d{6}-[1-4]\d{6}",
    "전화번호": r"01[016789]-\d{3,4}-\d{4}",
    "이메일": r"[\w.\-]+@[\w\-]+\.[a-zA-Z]{2,}",
    "계좌번호": r"(?<!\d)\d{2,6}-\d{2,6}-\d{2,10}(?!\d)",
    "AWS_Access_Key": r"AKIA[0-9A-Z]{16}",
    "DB_접속문자열": r"(?:postgres|mysql|mongodb|redis)(?:\+\w+)?://\S+",
    "Private_Key_PEM": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "JWT_Token": r"eyJ[\w-]+\.[\w-]+\.[\w-]+",
    "GitHub_Token": r"ghp_[A-Za-z0-9]{20,}",
    "Slack_Token": r"xox[baprs]-[A-Za-z0-9\-]{10,}",
}
ACCOUNT, DATE_SHAPE = "계좌번호", r"^(19|20)\d{2}-\d{2}-\d{2}$"


def catalogue_matches(text: Column, kind: str) -> Column:
    """array<string>: what the catalogue's pattern of a kind finds."""
    found = F.regexp_extract_all(text, F.lit(f"(?U){CATALOGUE[kind]}"), F.lit(0))
    return F.filter(found, lambda x: ~x.rlike(DATE_SHAPE)) if kind == ACCOUNT else found


def catalogue_counts(text: Column) -> Column:
    """array<struct<kind, n>> of the catalogue's kinds that are in a text, in its order."""
    counts = F.array(*[F.struct(F.lit(k).alias("kind"), F.size(catalogue_matches(text, k)).alias("n")) for k in CATALOGUE])
    return F.filter(counts, lambda c: c["n"] > 0)


#: This library's own sample of a rule table.
SAMPLE_RULES = (
    Rule("R001", "HEX_TOKEN", r"[0-9a-f]{32,64}", 0.9, ("token", "api_key", "secret"), True),
    Rule("R002", "AWS_ACCESS_KEY", r"AKIA[0-9A-Z]{16}", 0.95),
)


def read_rules(spark, path: str) -> tuple[Rule, ...]:
    """The enabled rules of a table at a path (Parquet); a missing table is an error, as one without rules is."""
    from leakloom.sources.formats import exists

    if not exists(spark, path):
        raise FileNotFoundError(f"no rule table at {path}")
    return load_rules(spark.read.parquet(path))


def load_rules(rules: DataFrame) -> tuple[Rule, ...]:
    """The enabled rules of a (small) table, in order of rule_id; no enabled rule is an error."""
    rows = rules.where("enabled = 1").orderBy("rule_id").collect()
    if not rows:
        raise ValueError("the rule table has no enabled rules")
    words = lambda text: tuple(x.strip() for x in (text or "").split(",") if x.strip())
    return tuple(Rule(r["rule_id"], r["entity_type"], r["pattern"], float(r["score"]), words(r["context_keywords"]), bool(r["requires_context"])) for r in rows)


def all_hits(text: Column, recognizers=PERSONAL_DATA, as_of: Column | None = None) -> Column:
    """Hits of all recognizers in order of start, end and type; overlapping hits of different types all stay."""
    as_of = F.current_date() if as_of is None else as_of
    found = F.concat(*[r.hits(text, as_of) for r in recognizers]) if recognizers else F.array()
    return F.array_sort(found.cast(HITS))


def hit_counts(hits: Column) -> Column:
    """"TYPE:n,TYPE:n" in order of type; null without hits."""
    kinds = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["entity_type"])))
    counted = F.transform(kinds, lambda k: F.concat_ws(":", k, F.size(F.filter(hits, lambda h: h["entity_type"] == k)).cast("string")))
    return F.when(F.size(hits) > 0, F.array_join(counted, ","))
