"""Rules on page addresses, found by their rarest word.

A rule is a pattern of literal text with ``*`` (anything), ``^`` (a character
that is no letter, digit, ``_``, ``-``, ``.`` or ``%``, or the end), ``|`` at
either end (start or end of the address) and ``||`` at the start (start of the
host or of a label in it). Its words that must stand whole in any fitting address
are its tokens. A rule is filed under the token that the fewest rules have; the
tokens of an address fetch the rules filed under them, and only those run their
regular expressions. Rules without a token are tried on every address.

Rules are configuration, a list in the caller's program of at most ``MOST_RULES``;
they go to the tasks with the code. Nothing is shuffled, so no host is hot.
Addresses are judged one by one: a null one, or one without ``://``, has an empty
host and path, and gets the default verdict unless a rule fits the empty address.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.llm.common import with_columns

MOST_RULES = 100_000
ALLOW, BLOCK = "allow", "block"
TOKEN = re.compile(r"[a-z0-9%]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
START = re.compile(r"\A(.*?)://([^/?#]*)([^?#]*)", re.DOTALL)


@dataclass(frozen=True)
class Rule:
    """``name`` is what results show; the fitting rule of highest ``rank`` wins, then the first by name."""

    pattern: str
    verdict: str
    name: str
    rank: int = 0


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with its subdomains and paths that start so; the longest wins."""
    return Rule(f"||{host}{path}", verdict, host + path, len(host + path))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    found = START.match(url or "")
    return (found[2].translate(LOWER), found[3]) if found else ("", "")


def expression(pattern: str) -> re.Pattern:
    """The pattern as a regular expression over host and path."""
    body, begin, end = pattern, "", ""
    if body.startswith("||"):
        body, begin = body[2:], r"\A(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, begin = body[1:], r"\A"
    if body.endswith("|"):
        body, end = body[:-1], r"\Z"
    special = {"*": ".*", "^": r"(?:[^A-Za-z0-9_\-.%]|\Z)"}
    return re.compile(begin + "".join(special.get(c) or re.escape(c) for c in body) + end, re.DOTALL)


def tokens(pattern: str) -> list[str]:
    """Words of the pattern that stand whole in every address it fits."""
    body, found = pattern, []
    closed = body.startswith("|")
    body = body.lstrip("|")
    if body.endswith("|"):
        body, last = body[:-1], True
    else:
        last = False
    for m in re.finditer(r"[A-Za-z0-9%]+", body):
        left = body[m.start() - 1] != "*" if m.start() else closed
        right = body[m.end()] != "*" if m.end() < len(body) else last
        if left and right:
            found.append(m[0].lower())
    return found


class RuleIndex:
    """Rules filed under their rarest token."""

    def __init__(self, rules: Iterable[Rule]):
        rules = list(rules)
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} go to the tasks at once")
        counts = Counter(t for r in rules for t in set(tokens(r.pattern)))
        self.filed: dict[str, list[tuple[Rule, re.Pattern]]] = defaultdict(list)
        for r in rules:
            key = min(tokens(r.pattern), key=lambda t: (counts[t], -len(t), t), default="")
            self.filed[key].append((r, expression(r.pattern)))

    def candidates(self, address: str) -> list[tuple[Rule, re.Pattern]]:
        words = {"", *TOKEN.findall(address.translate(LOWER))}
        return [x for w in words if w in self.filed for x in self.filed[w]]

    def best(self, address: str) -> Rule | None:
        fitting = [r for r, e in self.candidates(address) if e.search(address)]
        return min(fitting, key=lambda r: (-r.rank, r.name, r.verdict), default=None)


def judge(
    pages: DataFrame, base: Iterable[Rule], more: Iterable[Rule] = (), default: str = ALLOW,
    url: str = "url", keep: list[str] | None = None,
) -> DataFrame:
    """The kept columns, ``host``, ``path``, ``rule`` and ``verdict`` of every page, and ``pattern``.

    ``rule`` is the best fitting base rule's name, else null. The verdict is that
    rule's; without one the best of ``more`` decides (its name is ``pattern``),
    else the default.
    """
    base, more = list(base), list(more)

    def make():
        first, second = RuleIndex(base), RuleIndex(more)

        def one(address):
            host, path = split_url(address)
            rule = first.best(host + path)
            other = None if rule else second.best(host + path)
            verdict = rule.verdict if rule else other.verdict if other else default
            return host, path, rule and rule.name, verdict, other and other.name

        return lambda urls: list(zip(*map(one, urls)))

    names = ("host", "path", "rule", "verdict", "pattern")
    return with_columns(pages, make, [(n, T.StringType()) for n in names], url, keep)
