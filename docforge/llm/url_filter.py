"""URL filtering by a bit-parallel automaton: all glob rules run at once in multiword Shift-And masks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import pieces

ANY, STAR = -1, -2
#: The end of the host in a canonical URL; no URL byte has this value after canonicalisation.
END = 1
SPLIT = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
UPPER = {c: c + 32 for c in range(65, 91)}

#: Rules (host and path, verdict). A rule fits its host, all subdomains, and paths that start with its own.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Globs over .host/path for URLs without a rule; the first that fits gives the verdict, and without any the URL is allowed.
GLOBS = (("*casino*/*", "block"), ("*poker*/*", "block"), ("*porn*/*", "block"), ("*xxx*/*", "block"), ("*viagra*/*", "block"), ("*/*.exe", "block"), ("*/*.zip", "block"), ("*/ads/*", "block"))


def canonical(url: str | None) -> tuple[str, str]:
    """Host, in lower case, and path; both empty for null or without "://"."""
    found = SPLIT.search(url) if url else None
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


def _line(host: str, path: str) -> bytes:
    return b"." + host.encode("utf-8", "surrogatepass").replace(b"\x01", b"\x02") + b"\x01" + path.encode("utf-8", "surrogatepass").replace(b"\x01", b"\x02")


def rule_symbols(rule: str) -> list[int]:
    """A host-and-path rule as symbols: *.host END path*."""
    host, _, path = rule.partition("/")
    return [STAR, *f".{host}".encode(), END, *f"/{path}".encode(), STAR]


def glob_symbols(glob: str) -> list[int]:
    """A glob as symbols; its first slash ends the host, * is any run and ? any one byte."""
    host, _, path = glob.partition("/")
    code = lambda s: [STAR if c == 42 else ANY if c == 63 else c for c in s.encode()]
    return [*([] if host.startswith("*") else [46]), *code(host), END, 47, *code(path)] if "/" in glob else [STAR, *code(glob), STAR]


class Automaton:
    """Shift-And over packed 64-bit words. Each pattern owns a start bit and a bit for each symbol but stars; a star lets the bit before it stay set."""

    def __init__(self, patterns: Sequence[Sequence[int]]) -> None:
        n = sum(1 + sum(s != STAR for s in p) for p in patterns)
        self.words = max(1, -(-n // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros(self.words, np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.ends = []
        bit = 0
        for p in patterns:
            self._set(self.start, bit)
            for s in p:
                if s == STAR:
                    self._set(self.stay, bit)
                    continue
                bit += 1
                for c in range(256) if s == ANY else (s,):
                    self._set(self.step[c], bit)
            self.ends.append(bit)
            bit += 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << bit % 64)

    def match(self, lines: Sequence[bytes]) -> np.ndarray:
        """A row for each line, a column for each pattern: whether it fits the whole line."""
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        order = np.argsort(-size, kind="stable")  # those still running are always a prefix
        begins = np.cumsum(size) - size
        data = np.frombuffer(b"".join(lines), np.uint8)
        state = np.tile(self.start, (len(lines), 1))
        alive, sizes, begins = len(lines), size[order], begins[order]
        for t in range(int(sizes[0]) if len(lines) else 0):
            while sizes[alive - 1] <= t:
                alive -= 1
            now = state[:alive]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:alive] = (moved & self.step[data[begins[:alive] + t]]) | (now & self.stay)
        out = np.empty((len(lines), len(self.ends)), bool)
        for k, bit in enumerate(self.ends):
            out[order, k] = state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1) > 0
        return out


def judge(urls: Sequence[str | None], automaton: Automaton, rules: Sequence[tuple[str, str]], globs: Sequence[tuple[str, str]]) -> Iterator[tuple[str, str, str | None, str]]:
    parts = [canonical(u) for u in urls]
    fits = automaton.match([_line(h, p) for h, p in parts])
    by_length = sorted(range(len(rules)), key=lambda k: -len(rules[k][0]))
    for (host, path), row in zip(parts, fits, strict=True):
        k = next((k for k in by_length if row[k]), None)
        verdict = rules[k][1] if k is not None else next((v for j, (_, v) in enumerate(globs) if row[len(rules) + j]), "allow")
        yield host, path, None if k is None else rules[k][0], verdict


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, globs: Sequence[tuple[str, str]] = GLOBS) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages(page_id, url, ...).

    The longest rule that fits gives the verdict, then the first glob, else the URL is allowed.
    A null URL or one without "://" has an empty host and path, which no rule fits.
    Rows are judged alone, and the longest of some megabytes of URLs sets how many steps the automaton takes for them:
    repeated rows repeat, a null page_id stays, an empty table stays empty, other columns don't matter.
    """
    schema = f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([*(rule_symbols(r) for r, _ in rules), *(glob_symbols(g) for g, _ in globs)])
        for b in batches:
            for start, part in pieces(b.column("url")):
                found = list(judge(part.to_pylist(), automaton, rules, globs))
                yield pa.RecordBatch.from_arrays([b.column("page_id").slice(start, len(part)), *(pa.array([f[k] for f in found], pa.string()) for k in range(4))], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(run, schema)


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN path LIKE '/%' AND (regexp_matches(host, 'casino|poker|porn|xxx|viagra') OR path LIKE '%.exe' OR path LIKE '%.zip' OR path LIKE '%/ads/%') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""
