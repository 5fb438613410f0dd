"""URL filters by a bit-parallel wildcard automaton.

All glob rules are laid one after another into one row of state bits (a Python integer: as many
machine words as needed). One Shift-And step per symbol moves every rule at once; a ``*`` is a state
that loops on the symbols it may take. What is read is a host, a boundary symbol that no text
contains, and a path, so a star in the host part cannot run into the path.

Two automata judge a URL: the allow and block rules over its host and path as they stand, and, where
none of these fits, a list of globs over its canonical form.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from shardsort.llm.common import arrow_rows, bounded_batches, widened

#: Stands between host and path; not a code point.
BOUNDARY = -1
_UPPER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """`name` is what is reported; `host` holds for subdomains too; `path` is a prefix."""

    name: str
    verdict: str
    host: str
    path: str


#: The rules of the query: fixed values. Name, verdict, host, path.
BASE_RULES = (
    Rule("com/", "allow", "com", "/"),
    Rule("example.com/en/", "block", "example.com", "/en/"),
    Rule("www.example.com/en/", "allow", "www.example.com", "/en/"),
    Rule("net/es/", "block", "net", "/es/"),
    Rule("net/fr/", "block", "net", "/fr/"),
)

#: Words that as a whole word of a host block a URL to which no rule applies: fixed values.
BLOCKED_WORDS = tuple("adult ads bets casino malware phishing pills porn spam xxx".split())
#: Paths that do so on any host: fixed values.
BLOCKED_PATHS = ("*/casino/*", "*/porn/*", "*/spam/*", "*/adserver/*", "*/doubleclick/*")


def word_globs(word: str) -> tuple[tuple[str, str], ...]:
    """Globs for a whole word of a host: between dots or hyphens, so `spills.org` holds no `pills`."""
    return tuple((f"*{a}{word}{b}*", "*") for a in ".-" for b in ".-")


#: The method's own list: (host glob, path glob) over canonical URLs, the host with a dot before and after.
BLOCKED = tuple(g for word in BLOCKED_WORDS for g in word_globs(word)) + tuple(("*", path) for path in BLOCKED_PATHS)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
_UNRESERVED = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~")


def _percent(found: re.Match) -> str:
    c = chr(int(found[1], 16))
    return c if c in _UNRESERVED else found[0].upper()


def canonical(url: str | None) -> tuple[str, str]:
    """Host between dots, and path with query, of a URL's canonical form; a dot and nothing where there is no `://`.

    Users, default ports, a last dot of the host and fragments go, unreserved characters are never
    percent-encoded, dot segments are resolved, an empty path is `/`, A-Z are lower-cased.
    """
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return ".", ""
    rest = rest.partition("#")[0]
    end = min((at for at in (rest.find("/"), rest.find("?")) if at >= 0), default=len(rest))
    host, tail = rest[:end].rpartition("@")[2], rest[end:]
    name, colon, port = host.rpartition(":")
    if colon and port in ("", "80" if scheme.lower() == "http" else "443" if scheme.lower() == "https" else ""):
        host = name
    path, mark, query = _PERCENT.sub(_percent, tail).partition("?")
    parts: list[str] = []
    for part in path.split("/")[1:]:
        if part == ".." and parts:
            parts.pop()
        elif part not in (".", ".."):
            parts.append(part)
    if path.endswith(("/.", "/..")):
        parts.append("")
    host = _PERCENT.sub(_percent, host).translate(_UPPER).removesuffix(".")
    return f".{host}.", ("/" + "/".join(parts) + mark + query).translate(_UPPER)


def symbols_of(glob: str) -> list[int | None]:
    """Code points of a glob; None stands for a star. A backslash makes the next character a plain one."""
    out: list[int | None] = []
    plain = False
    for c in glob:
        if plain or c not in "*\\":
            out.append(ord(c))
            plain = False
        elif c == "*":
            out.append(None)
        else:
            plain = True
    if plain:
        raise ValueError(f"nothing follows the last backslash of {glob!r}")
    return out


def literal(text: str) -> str:
    """A glob that only the text itself matches."""
    return text.replace("\\", "\\\\").replace("*", "\\*")


class GlobAutomaton:
    """Simulates all patterns at once; a pattern is a host glob and a path glob."""

    def __init__(self, patterns: Sequence[tuple[str, str]]):
        self.starts = self.finals = self.host_loops = self.path_loops = 0
        self.masks: dict[int, int] = {}
        self.final_of: list[tuple[int, int]] = []
        at = 0
        for k, (host, path) in enumerate(patterns):
            self.starts |= 1 << at  # nothing read yet
            for part, symbols in ((0, [*symbols_of(host), BOUNDARY]), (1, symbols_of(path))):
                for c in symbols:
                    if c is None:
                        if part == 0:
                            self.host_loops |= 1 << at
                        else:
                            self.path_loops |= 1 << at
                    else:
                        at += 1
                        self.masks[c] = self.masks.get(c, 0) | 1 << at
            self.final_of.append((1 << at, k))
            self.finals |= 1 << at
            at += 1

    def matches(self, host: str, path: str) -> list[int]:
        """Numbers of the patterns that match host and path."""
        state, masks = self.starts, self.masks.get
        loops = self.host_loops
        for c in map(ord, host):
            state = ((state << 1) & masks(c, 0)) | (state & loops)
        state = (state << 1) & masks(BOUNDARY, 0)
        loops = self.path_loops
        for c in map(ord, path):
            if not state:
                return []
            state = ((state << 1) & masks(c, 0)) | (state & loops)
        return [k for bit, k in self.final_of if state & bit] if state & self.finals else []


class UrlJudge:
    """Longest fitting rule, else block where a glob matches the canonical URL, else allow."""

    def __init__(self, rules: Sequence[Rule], blocked: Sequence[tuple[str, str]]):
        self.rules = rules
        patterns = []
        for rule in rules:
            patterns.append((literal(rule.host), literal(rule.path) + "*"))
            patterns.append(("*." + literal(rule.host), literal(rule.path) + "*"))
        self.ruled, self.globs = GlobAutomaton(patterns), GlobAutomaton(blocked)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        """Host, path, rule and verdict."""
        host, path = split_url(url)
        fitting = [self.rules[k // 2] for k in self.ruled.matches(host, path)]
        if fitting:
            best = max(fitting, key=lambda r: (len(r.name), r.name))
            return host, path, best.name, best.verdict
        return host, path, None, "block" if self.globs.matches(*canonical(url)) else "allow"


def url_verdicts(df: DataFrame, url: str = "url", rules: Sequence[Rule] = BASE_RULES, blocked: Sequence[tuple[str, str]] = BLOCKED) -> DataFrame:
    """Add host, path, rule (null where none fits) and verdict (allow or block) to every row.

    A rule fits its host and all its subdomains where the path starts with the rule's; the longest
    name wins, ties go to the greater name. Where none fits, a URL is blocked if its canonical form
    matches a pair of globs for host and path (``*`` is any run of characters, a backslash takes the
    next character as it is). Null, empty and malformed URLs have empty host and path; URLs of any
    length are read whole; repeated rows are judged alike; an empty table gives no rows. The four
    result columns replace columns of those names.
    """
    bounded_batches(df.sparkSession)
    out = ("host", "path", "rule", "verdict")
    kept = df.drop(*(c for c in out if c != url))
    schema = widened(kept, "host string, path string, rule string, verdict string")
    rules, blocked = tuple(rules), tuple(blocked)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = UrlJudge(rules, blocked)
        for batch in batches:
            rows = [judge.judge(u) for (u,) in arrow_rows(batch, url)]
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *out])

    return kept.mapInArrow(run, schema)


def _sql() -> str:
    def like(rule: Rule) -> str:
        return f"((host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))"

    longest = sorted(BASE_RULES, key=lambda r: -len(r.name))
    rule = " ".join(f"WHEN {like(r)} THEN '{r.name}'" for r in longest)
    verdict = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in BASE_RULES)
    paths = "|".join(path.strip("*") for path in BLOCKED_PATHS)
    blocked = rf"regexp_matches(bare, '(^|[.-])({'|'.join(BLOCKED_WORDS)})([.-]|$)') OR regexp_matches(tail, '{paths}')"
    return f"""
        WITH rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS all_of,
                   regexp_replace(all_of, '(?s)[?#].*$', '') AS r FROM pages
        ), parts AS (
            SELECT page_id, translate(CASE WHEN strpos(r, '/') > 0 THEN substr(r, 1, strpos(r, '/') - 1) ELSE r END,
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   CASE WHEN strpos(r, '/') > 0 THEN substr(r, strpos(r, '/')) ELSE '' END AS path,
                   regexp_replace(regexp_replace(host, '^.*@', ''), '(:(80|443)?)?$', '') AS bare,
                   lower(regexp_replace(regexp_replace(all_of, '(?s)#.*$', ''), '^[^/?]*', '')) AS tail FROM rest
        ), ruled AS (SELECT *, CASE {rule} END AS rule FROM parts)
        SELECT page_id, host, path, rule, CASE {verdict} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""


ORACLE = _sql()
