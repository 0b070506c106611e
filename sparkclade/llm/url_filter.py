"""URL filters: pattern rules indexed by their rarest literal token.

The literal tokens that any URL must hold to fit a pattern are read off the pattern itself.  Over all URLs the tokens are
counted, and a rule is filed under its rarest.  A URL's own tokens then fetch the candidate rules, and only those run
their regular expressions, with the few rules that need no token.  Host rules are looked up by the suffixes of the host
in the same way.
"""

from __future__ import annotations

import functools
import re
import re._constants as sre
from dataclasses import dataclass
from re._parser import parse as sre_parse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def pieces(parsed, flags: int = 0) -> list[str | None]:
    """A parsed pattern as what stands one after another for certain: a letter or digit, ``""`` for something that is neither
    or an end of the text, None for anything else, or for nothing.  ``flags`` hold where it begins."""
    out: list[str | None] = []
    blind = bool(flags & re.I)
    for op, value in parsed:
        if op is sre.LITERAL:
            out.append(literal(chr(value), flags))
        elif op is sre.AT:
            out.append("" if value in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING, sre.AT_END, sre.AT_END_STRING, sre.AT_BOUNDARY) else None)
        elif op is sre.IN:
            # Without regard to case a class may hold a letter by its capital, or by a character beyond ASCII.
            letters = LETTERS + UPPER if blind else LETTERS
            wide = blind and any(x > 127 for kind, v in value for x in (v if kind is sre.RANGE else (v,)) if isinstance(x, int) and kind in (sre.LITERAL, sre.RANGE))
            out.append(None if wide or any(in_class(value, c) for c in letters) else "")
        elif op is sre.SUBPATTERN:
            out += pieces(value[-1], (flags | value[1]) & ~value[2])
        elif op is sre.BRANCH:
            # What parts tokens in every branch parts them.
            out.append("" if all(pieces(x, flags) == [""] for x in value[1]) else None)
        else:
            out.append(None)
    return out


def literal(c: str, flags: int) -> str | None:
    """The piece of one character.  Without regard to case, i, k and s have partners beyond ASCII, whose tokens differ."""
    if not flags & re.I:
        return c if c in LETTERS else ""
    low = c.lower() if c.isascii() else c
    if not c.isascii() or low in "iks" and not flags & re.A:
        return None
    return low if low in LETTERS else ""


def in_class(items, c: str) -> bool:
    """Whether a character class may hold ``c``."""
    hit = False
    for op, value in items:
        if op is sre.LITERAL:
            hit |= value == ord(c)
        elif op is sre.RANGE:
            hit |= value[0] <= ord(c) <= value[1]
        elif op is sre.CATEGORY:
            hit |= value in (sre.CATEGORY_WORD, sre.CATEGORY_NOT_SPACE) or (value is sre.CATEGORY_DIGIT) == c.isdigit() and value in (sre.CATEGORY_DIGIT, sre.CATEGORY_NOT_DIGIT)
    return not hit if items and items[0][0] is sre.NEGATE else hit


@functools.lru_cache(maxsize=None)
def literal_tokens(pattern: str) -> tuple[str, ...]:
    """The whole runs of a-z0-9 that a lower-case text cannot lack if ``pattern`` is found in it; there may be none."""
    out, run, open_ = [], "", False
    parsed = sre_parse(pattern, re.S)
    for piece in pieces(parsed, parsed.state.flags):
        if piece:
            run += piece
            continue
        # A run counts if something parts it from what is before and after it.
        if piece == "" and run and open_:
            out.append(run)
        run, open_ = "", piece == ""
    return tuple(dict.fromkeys(out))


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` is searched in the URL in lower case (A-Z)."""

    verdict: str
    pattern: str

    @property
    def tokens(self) -> tuple[str, ...]:
        return literal_tokens(self.pattern)


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


HOST_RULES = (HostRule("block", "net", "/"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/"))

#: What no host rule decides.  Alternatives are rules of their own, so that each has its token.
PATTERN_RULES = (
    *(PatternRule("block", rf"(^|[^a-z0-9]){x}([^a-z0-9]|$)") for x in ("casino", "porn", "xxx", "torrent")),
    *(PatternRule("block", rf"://{x}[.]([^/?#]*[.])?(com|net|org)([:/?#]|$)") for x in ("ads", "adserver", "doubleclick", "tracker")),
    *(PatternRule("block", rf"[?&]{x}=[^&#]") for x in ("sessionid", "phpsessid")),
    *(PatternRule("block", rf"/wp-{x}([^a-z0-9]|$)") for x in ("admin", "login")),
    PatternRule("block", r"/cgi-bin/"),
    PatternRule("allow", r"/wp-login/help([/?#]|$)"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filed(urls: DataFrame, rules: tuple[PatternRule, ...]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by the rarest of their tokens, counted over all of ``urls`` (url), ties by token; and those without any."""
    wanted = sorted({t for r in rules for t in r.tokens})
    words = F.array_distinct(F.split(F.translate("url", UPPER, LOWER), "[^a-z0-9]+"))
    # The rules come with the call, so their tokens are as small as what the driver holds already.
    listed = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    held = urls.where("url is not null").select(F.explode(words).alias("token")).join(F.broadcast(listed), "token")
    n = {r.token: r.n for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        if r.tokens:
            index.setdefault(min(r.tokens, key=lambda t: (n.get(t, 0), t)), []).append(i)
    return index, [i for i, r in enumerate(rules) if not r.tokens]


def read_rules(rules: DataFrame) -> tuple[PatternRule, ...]:
    """Rules of a table (verdict, pattern), such as ``spark.read.csv`` gives, in order of pattern."""
    return tuple(PatternRule(r.verdict, r.pattern) for r in rules.select("verdict", "pattern").orderBy("pattern", "verdict").collect())


def url_filter(pages: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern), a row for each row of ``pages``.

    The longest host rule that fits decides, and is named in ``rule``; else the pattern rule of the longest pattern that
    fits, ties by place in the list; else the verdict is allow.  A null url and one without ``://`` have an empty host
    and path; pattern rules still see the latter.  Very long URLs are looked at whole.  Repeated rows each get a row.
    Extra columns are ignored; an empty table gives an empty table.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    index, always = filed(rows, pattern_rules)
    compiled: dict[int, re.Pattern] = {}
    by_host: dict[str, list[HostRule]] = {}
    for r in sorted(host_rules, key=lambda r: -len(r.host + r.path)):
        by_host.setdefault(r.host, []).append(r)

    def host_rule(host: str, path: str) -> HostRule | None:
        found = []
        while host:
            found += [r for r in by_host.get(host, ()) if path.startswith(r.path)]
            host = host.partition(".")[2]
        return max(found, key=lambda r: len(r.host + r.path), default=None)

    def found_in(i: int, text: str) -> bool:
        if i not in compiled:
            compiled[i] = re.compile(pattern_rules[i].pattern, re.S)
        return compiled[i].search(text) is not None

    def judge(batches):
        for b in batches:
            out = []
            for url, host, path in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                fixed, low = host_rule(host, path), (url or "").translate(FOLD)
                fits = [] if fixed else [i for i in sorted({*always, *(i for t in set(TOKEN.findall(low)) for i in index.get(t, ()))}) if found_in(i, low)]
                best = pattern_rules[max(fits, key=lambda i: (len(pattern_rules[i].pattern), -i))] if fits else None
                out.append((f"{fixed.host}{fixed.path}" if fixed else None, (fixed or best).verdict if fixed or best else "allow", best.pattern if best else None))
            cells = [pa.array([x[i] for x in out], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *cells], ["page_id", "host", "path", "rule", "verdict", "pattern"])

    kind = rows.schema["page_id"].dataType.simpleString()
    split = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return split.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")
