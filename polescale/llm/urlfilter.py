"""URL filter: host and path rules first, then a weighted vocabulary.

Rules are (host, path, verdict). A rule fits its host and all subdomains, if
the url's path starts with the rule's path; of several the longest (host and
path together) wins.

Without a rule, an Aho-Corasick automaton finds all vocabulary terms in the
whole url, percent-decoded and lower-cased, in one pass. A hit counts only if
no letter or digit touches it. Each term has a weight; the weights of distinct
hits are added up, and from ``REJECT`` on the url is rejected: strict terms
weigh that much alone, so one of them or ``SOFT_HITS`` distinct soft terms do.
The vocabulary is a parameter: lists, or the rows of a table by ``weighted``.

Defined results: null urls, and urls without ``://``, have empty host and
path and no rule; the vocabulary still judges the text of the latter. A null
or empty url is allowed. Of equally long rules that fit, the first in the list
wins. Broken percent codes stay as they are. Very long urls are judged whole.
Repeated rows, also with null or repeated ids, get the same verdict each; an
empty table gives an empty result; extra columns, with whatever names, are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rules of the production query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

# The vocabulary, terms that reject alone.
STRICT = """
adult bdsm bestporn bingo blackjack bukkake camgirl camgirls camsex casino casinos cialis cracked crackz cumshot erotic erotica escort escorts fetish
gambling gangbang hentai hardcore incest keygen keygens levitra lolita malware milf nude nudes nudity onlyfans phishing porn porno pornhub pornography
ransomware roulette serialz sexcam sexcams sextape sexchat shemale softcore spyware strip striptease swingers tramadol upskirt viagra voyeur warez webcamsex xanax xhamster xnxx xvideos xxx
""".split()
# The vocabulary, terms of which several must meet.
SOFT = """
ads affiliate auction babe babes baccarat bet bets betting bitcoin bonus cash cheap click clickbait clicks coupon coupons crypto dating deals diet discount doubleclick
download earn farm forex free freebies gamble giveaway hack hacks hot jackpot keno lingerie loan loans lottery lotto lucky meds millionaire mlm money mortgage offers
payday pharmacy pills poker popup prize prizes promo proxy replica replicas rich rx sale sex sexy sites singles slot slots spam spins sportsbook supplement supplements sweepstakes teen teens
ticket torrent torrents track tracker unblocked vip voucher vouchers wager watches weightloss win winner winners
""".split()
SOFT_HITS = 2
#: Weight of all distinct hits from which a url is rejected.
REJECT = 1.0

_LOWER = {i: i + 32 for i in range(65, 91)}
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    m = _PARTS.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def rule_of(by_host: dict[str, list[tuple[str, str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    best, at = None, 0
    while host:
        for start, name, verdict in by_host.get(host[at:], ()):
            if path.startswith(start) and (best is None or len(name) > len(best[0])):
                best = (name, verdict)
        at = host.find(".", at) + 1
        if not at:
            break
    return best


def weighted(strict: list[str], soft: list[str], soft_hits: int = SOFT_HITS) -> dict[str, float]:
    """Term -> weight; a strict term that is also listed as soft is strict."""
    return {t.translate(_LOWER): REJECT / soft_hits for t in soft} | {t.translate(_LOWER): REJECT for t in strict}


def automaton(terms: dict[str, float]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t, weight in terms.items():
        a.add_word(t, (weight, t))
    a.make_automaton()
    return a


def vocabulary_hits(a, url: str) -> tuple[int, int, float]:
    """Of the distinct terms of the url that stand alone: how many reject by themselves, how many don't, and their weight."""
    found = set()
    for end, (weight, term) in a.iter(url) if len(a) else ():
        start = end - len(term) + 1
        if not (start and url[start - 1].isalnum()) and not (end + 1 < len(url) and url[end + 1].isalnum()):
            found.add((weight, term))
    n = sum(w >= REJECT for w, _ in found)
    return n, len(found) - n, sum(w for w, _ in found)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, terms: dict[str, float] | None = None) -> DataFrame:
    """``page_id, host, path, rule, strict_hits, soft_hits, verdict`` for each row of ``pages``."""
    terms = weighted(STRICT, SOFT) if terms is None else terms
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for host, start, verdict in rules:
        by_host.setdefault(host, []).append((start, host + start, verdict))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(terms)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                rule = rule_of(by_host, host, path)
                hard, mild, weight = vocabulary_hits(a, unquote(url or "").translate(_LOWER))
                verdict = rule[1] if rule else "block" if weight > REJECT - 1e-9 else "allow"
                for to, x in zip(out, (host, path, rule and rule[0], hard, mild, verdict), strict=True):
                    to.append(x)
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out, kinds)], names=["page_id", "host", "path", "rule", "strict_hits", "soft_hits", "verdict"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, "page_id long, host string, path string, rule string, strict_hits long, soft_hits long, verdict string")
