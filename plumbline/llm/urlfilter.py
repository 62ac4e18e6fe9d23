"""URL filter: prefix rules first, gradient-boosted trees on lexical features for all other URLs.

The trees are fitted on labelled URLs: a built-in table that is written out from how spam and ordinary
addresses are commonly made, and a bounded sample of the table's own URLs that a rule covers, each labelled
with the rule's verdict. Features are lexical only: length, depth, digit ratio, entropy, parameter counts
and statistics of the host's suffix; none looks a word up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import bounded_sample, extended, mapped, table

#: (host, path, verdict), as the rules of the query are given.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Bound of the sample of rule-covered URLs that the trees are fitted on.
MAX_FIT = 6000
TREES, DEPTH, RATE, BINS, LEAST = 60, 3, 0.2, 32, 8

_HOST = re.compile(r"://([^/?#]*)")
_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or a text without ``://``."""
    m = _HOST.search(url or "")
    if not m:
        return "", ""
    rest = url[m.end() :]
    return m.group(1).translate(_ASCII_LOWER), re.split(r"[?#]", rest, maxsplit=1)[0]


def with_host_and_path(url: Column) -> tuple[Column, Column]:
    """The same as `split`, as Spark expressions."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"\A([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits, null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for name, prefix, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    n = np.unique(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), return_counts=True)[1] / len(text.encode("utf-8", "replace"))
    return float(-(n * np.log2(n)).sum())


def _suffix(host: str) -> str:
    return host.rsplit(".", 1)[-1]


@dataclass
class UrlModel:
    """bias and trees of (feature, cut, value) nodes in heap order; suffixes: smoothed share of blocked URLs by host suffix."""

    bias: float
    suffixes: dict[str, float]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def features(self, url: str | None) -> list[float]:
        host, path = split(url)
        rest = url or ""
        labels, query = host.split("."), rest.partition("?")[2].partition("#")[0]
        name = max(labels, key=len)
        values = [x.partition("=")[2] for x in query.split("&")] if query else []
        vowels = sum(c in "aeiouy" for c in name)
        return [
            len(rest), len(host), len(path), len(query), len(labels), len(name), path.count("/"), host.count("-"), path.count("-") + path.count("_"),
            sum(c.isdigit() for c in rest) / max(1, len(rest)), sum(c.isdigit() for c in host) / max(1, len(host)), sum(c.isdigit() for c in path) / max(1, len(path)),
            _entropy(host), _entropy(path), _entropy(query), _entropy(name), len(values), max(map(len, values), default=0), rest.count("%"),
            "#" in rest, rest.startswith("https"), "@" in rest, host.replace(".", "").isdigit(), vowels / max(1, len(name)),
            max((len(x) for x in re.findall(r"[^aeiouy0-9.-]+", name)), default=0), self.suffixes.get(_suffix(host), self.suffixes.get("", 0.5)),
        ]

    def block_probability(self, urls: list[str | None]) -> np.ndarray:
        x = np.asarray([self.features(u) for u in urls], dtype=float).reshape(len(urls), -1)
        z = np.full(len(urls), self.bias)
        for feature, cut, value in self.trees:
            node = np.zeros(len(urls), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(urls)), feature[node]] > cut[node])
            z += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-z))


def built_in_labels(n: int = 2400, seed: int = 3) -> list[tuple[str, int]]:
    """The built-in labelled URLs, half of them spam (1), the same for the same seed.

    Ordinary hosts are one or two syllabic names, seldom with a hyphen, and a short path; spam hosts chain
    names by hyphens, carry digits and random letters, or are bare numbers, and their URLs often carry long,
    coded parameters.
    """
    r = np.random.default_rng(seed)
    pick = lambda *items: items[r.integers(len(items))]
    name = lambda: "".join(pick("b", "d", "f", "g", "l", "m", "n", "p", "r", "s", "t", "v", "st", "tr", "ch") + pick("a", "e", "i", "o", "u", "ea", "er", "on") for _ in range(r.integers(2, 5)))
    code = lambda k, letters="abcdefghijklmnopqrstuvwxyz0123456789": "".join(pick(*letters) for _ in range(k))
    page = lambda: pick("", "/", f"/{name()}", f"/{name()}/", f"/{name()}/{name()}", f"/{name()}-{name()}.html", f"/{pick('en', 'es', 'fr', 'de')}/{r.integers(1, 9999)}", f"/{r.integers(1990, 2030)}/{r.integers(10, 13)}/{name()}", f"/{name()}?page={r.integers(1, 30)}", f"/{name()}.html#{name()}")

    def spam() -> str:
        host = pick(
            "-".join(name() for _ in range(r.integers(2, 6))), f"{name()}-{name()}{r.integers(10, 99999)}", code(r.integers(10, 22)), f"{name()}{r.integers(100, 10**6)}",
            f"{code(r.integers(5, 12))}.{name()}-{name()}-{r.integers(2, 999)}", f"{name()}-{code(4, '0123456789')}-{name()}-{name()}",
        ) + "." + pick("com", "net", "info", "biz", "top", "xyz", "click", "ru", "org")
        if r.random() < 0.1:
            host = ".".join(str(x) for x in r.integers(1, 255, 4))
        tail = pick(page(), f"/{code(r.integers(8, 30))}", f"/{name()}?id={code(16)}&ref={code(8)}&u={code(20)}", f"/?{code(3)}={code(24)}&{code(2)}={code(12)}", f"/{name()}/{code(12)}.php?{code(4)}={r.integers(10**6, 10**9)}")
        return f"http{pick('', '', 's')}://{pick('', '', 'www.', 'm.')}{host}{tail}"

    def plain() -> str:
        host = (f"{name()}-{name()}" if r.random() < 0.04 else pick(name(), name(), f"{name()}.{name()}", f"{name()}.example")) + "." + pick("com", "com", "net", "org", "org", "edu", "de", "fr", "co.uk", "info")
        return f"http{pick('', 's', 's')}://{pick('', 'www.', 'blog.', 'm.')}{host}{page()}"

    return [(spam(), 1) if k % 2 else (plain(), 0) for k in range(n)]


def fit(rows: list[tuple[str, int]]) -> UrlModel:
    """Histogram gradient boosting for log loss; without rows every URL gets probability 0.5."""
    y = np.asarray([label for _, label in rows], dtype=float)
    if not rows:
        return UrlModel(0.0, {})
    stats: dict[str, list[float]] = {}
    for url, label in rows:
        s = stats.setdefault(_suffix(split(url)[0]), [0.0, 0.0])
        s[0] += label
        s[1] += 1
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = UrlModel(float(np.log(rate / (1 - rate))), {k: (b + 10 * rate) / (n + 10) for k, (b, n) in stats.items()} | {"": rate})
    x = np.asarray([model.features(u) for u, _ in rows], dtype=float)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    bins = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)])
    z, inner = np.full(len(y), model.bias), 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        grad, curve = y - p, p * (1 - p)
        feature, cut, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
        for at in range(inner):
            inside = node == at
            g, h = grad[inside], curve[inside]
            best = (1e-9, -1, np.inf)
            for f, c in enumerate(cuts):
                b = bins[f][inside]
                gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=len(c) + 1))[:-1] for w in (g, h, np.ones(len(g))))
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
                gain[(nl < LEAST) | (len(g) - nl < LEAST)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, c[int(gain.argmax())])
            if best[1] >= 0:
                feature[at], cut[at] = best[1], best[2]
            node[inside] = 2 * at + 1 + (x[inside, feature[at]] > cut[at])
        leaf = node - inner
        value = RATE * np.bincount(leaf, weights=grad, minlength=inner + 1) / (np.bincount(leaf, weights=curve, minlength=inner + 1) + 1)
        z += value[leaf]
        model.trees.append((feature, cut, value))
    return model


def fit_frames(pages: DataFrame, rules=RULES, max_rows: int = MAX_FIT) -> UrlModel:
    """Trees fitted on the built-in labels and at most `max_rows` distinct rule-covered URLs, taken by a hash of the URL."""
    host, path = with_host_and_path(F.col("url"))
    covered = pages.select("url", rule_columns(host, path, rules)[1].alias("verdict")).where("verdict IS NOT NULL").distinct()
    rows = sorted((r.url, int(r.verdict == "block")) for r in bounded_sample(covered, max_rows, "url").collect())
    return fit(rows + built_in_labels())


def judge(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """`pages` with host, path, rule, block_probability and verdict after its own columns.

    Rows of equal id are judged each for itself; a URL may be as long as a row may be. A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the
    model like any other. Columns of `pages` that have one of the five names are replaced.
    """
    added = ["host", "path", "rule", "block_probability", "verdict"]
    pages = pages.drop(*added)
    at = pages.columns.index("url")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield extended(batch, pa.array(model.block_probability(batch.column(at).to_pylist())))

    host, path = with_host_and_path(F.col("url"))
    out = mapped(pages, scored, T.StructField("block_probability", T.DoubleType())).withColumns({"host": host, "path": path})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return out.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_model)}).select(*(F.col(f"`{c}`") for c in pages.columns), *added)


def op1_urlfilter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit_frames(pages)).select("page_id", "host", "path", "rule", "verdict", "block_probability")
