"""URL filtering: host and path rules, then logistic regression on hashed character n-grams.

The model is fitted once, on the driver, to a small labelled table of URLs made by
rule (labelled()); each URL is a bag of hashed n-grams of its host and of its path.
Rules come first; the longest that fits decides, of equally long ones the first by
name. They are looked up by the host's suffixes, so that a URL costs as many lookups
as its host has labels, whatever the number of rules.

A null url, or one without `://`, has an empty host and path; no rule fits it
and the model's bias alone scores it. Equal URLs get equal verdicts, extra
columns are ignored, an empty table gives an empty result. A URL of any length
is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

DIMENSIONS = 1 << 16
NGRAMS = (3, 4, 5, 6, 7)
THRESHOLD = 0.5
#: Rules that are sent to every worker, at most (about 300 MB); more are an error.
MOST_RULES = 1_000_000

#: (action, rule): a rule is a host and a path prefix; the host stands for its subdomains too.
RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
]

#: Words of hosts and paths from which the labelled table is made.
BLOCKED_WORDS = """spam spam-farm cheap pills casino poker betting bets slots jackpot viagra porn xxx adult-cams escort
payday loans replica warez torrent crack keygen free-money click-farm link-farm seo-links doorway fake-news-mill miracle-cure""".split()
CLEAN_WORDS = """blog news wiki docs library museum school university garden recipes history science weather travel sports music
journal archive forum health city market studio letters notes books art film maps data project open community review""".split()
PLACES = ["example.com", "example.org", "example.net"]
#: Letters around a blocked word that make another word of it.
WITHIN = ["{}ster", "{}etta", "{}mar", "{}man", "{}le", "{}ium", "{}ery", "{}eld", "ro{}", "al{}", "un{}", "bra{}", "wi{}n", "o{}ing", "s{}y", "{}s-and-sons", "ne{}land", "sto{}ed"]
#: Ends of hosts of the other tables' making.
ENDS = ["com", "org", "net", "gov", "edu", "ac.uk", "co.uk", "de", "fr", "es", "io", "info", "museum", "gc.ca"]
PATHS = ["/en/1", "/fr/22", "/de/333.html", "/es/44/", "/about", "/articles/2020/05/today", "/index.html", "/"]
#: Words and names that hold letters of blocked words and are none.
LOOKALIKES = """alphabet alphabets diabetes tibetan better betty between barbets abetting sherbets nutcracker crackers firecracker cracked hackney pharmacy pharmacist essex sussex middlesex
wessex github gitlab slotted timeslots slotcars casinum occasion occasional caslon pokeberry pokey spokes smoker escorial scorched loaner sloane reloaded balloons freeloader replicate replication
replicator torrential software hardware warehouse stoneware spamalot spanish spamming-study cheapside cheapstow spills caterpillar pillsbury upills popcorn capricorn unicorn porncic adulthood
adults-education keyboard keyguard hydrogen oxygen nitrogen freedom freemason moneypenny harmony ceremony seoul museo linkedin linking links-golf doors outdoors doorstep niagara viaduct agrarian holiday
birthday paypal payroll jackson jackdaw potluck crockpot farming farmers-market clicker clickable newsmill windmill watermill miracles curious secure manicure exxon maxx foxx pills-museum analyst""".split()
#: What stands around a word in a host; `free` and `best` may stand before either kind.
SHAPES = ["{}", "{}-win", "{}24", "my{}", "best-{}", "free-{}", "{}online", "the{}", "{}-world", "{}7"]


def labelled() -> list[tuple[str, str, int]]:
    """(host, path, blocked): each word in each shape as a host's label, and within paths of invented hosts."""
    rows = []
    for words, label in ((BLOCKED_WORDS, 1), (CLEAN_WORDS, 0)):
        for k, w in enumerate(words):
            for j, shape in enumerate(SHAPES):
                prefix = ["", "www.", "m.", "blog."][(k + j) % 4]
                rows.append((f"{prefix}{shape.format(w)}.{PLACES[(k + j) % 3]}", PATHS[(k + 3 * j) % len(PATHS)], label))
            rows.append((f"www.site{k}.example.org", f"/{w}/{k}", label))
    # words that look like blocked ones, under all kinds of ends
    for k, w in enumerate(LOOKALIKES):
        for j in range(3):
            prefix, shape = ["", "www.", "m.", "blog."][(k + j) % 4], ["{}", "{}", "my{}", "{}-world"][(k + 2 * j) % 4]
            rows.append((f"{prefix}{shape.format(w)}.{ENDS[(k + 5 * j) % len(ENDS)]}", PATHS[(k + j) % len(PATHS)], 0))
        rows.append((f"www.site{k}.example.org", f"/{w}/{k}", 0))
    for k, w in enumerate(CLEAN_WORDS):
        rows += [(f"{w}{other}.{ENDS[(k + j) % len(ENDS)]}", PATHS[(k + j) % len(PATHS)], 0) for j, other in enumerate(CLEAN_WORDS) if (k * 7 + j) % 11 == 0]
    # a blocked word within a longer one is none: the letters around it vary, but for those of SHAPES
    for k, w in enumerate(BLOCKED_WORDS):
        rows += [(f"{around.format(w)}.{ENDS[(k + 3 * j) % len(ENDS)]}", PATHS[(k + j) % len(PATHS)], 0) for j, around in enumerate(WITHIN)]
    for k, w in enumerate(BLOCKED_WORDS):
        rows += [(f"{shape.format(w)}.{ENDS[(k + j) % len(ENDS)]}", PATHS[(k + j) % len(PATHS)], 1) for j, shape in enumerate(SHAPES)]
    # invented hosts: syllables in any order are no reason to block
    syllables = "th re on an in er es st en ti ea ou nd la mi vo".split()
    for k in range(240):
        name = syllables[k % 16] + syllables[k * 7 % 16] + syllables[k * 3 // 2 % 16]
        rows.append((f"{['', 'www.', 'm.', 'blog.'][k % 4]}{name}.{PLACES[k % 3]}", PATHS[k % len(PATHS)], 0))
    return rows


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, dimension) of every n-gram of `^host` and of `path$`, all rows of a batch at once."""
    rows, dims = [], []
    for kind, texts in ((1, [f"^{h}^" for h in hosts]), (2, [f"{p}$" for p in paths])):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        for n in NGRAMS:
            if len(data) < n:
                continue
            m = len(data) - n + 1
            h = np.full(m, 0x9E3779B97F4A7C15 * kind & (2**64 - 1), np.uint64)
            for k in range(n):
                h = (h ^ data[k : k + m]) * np.uint64(0x100000001B3)
            same = owner[:m] == owner[n - 1 :]
            rows.append(owner[:m][same])
            dims.append(((h ^ (h >> np.uint64(29))) % np.uint64(DIMENSIONS)).astype(np.int64)[same])
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*dims, np.zeros(0, np.int64)])


def _sums(weights: np.ndarray, rows: np.ndarray, dims: np.ndarray, n: int) -> np.ndarray:
    """For each row, the weights of its n-grams over the root of their number."""
    counts = np.bincount(rows, minlength=n)
    return np.bincount(rows, weights[dims], minlength=n) / np.sqrt(np.maximum(counts, 1))


def train(rows: list[tuple[str, str, int]], rounds: int = 400, rate: float = 2.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full gradient steps on labelled rows; the same on every run."""
    r, d = features([x[0] for x in rows], [x[1] for x in rows])
    y = np.array([x[2] for x in rows], float)
    scale = 1 / np.sqrt(np.maximum(np.bincount(r, minlength=len(rows)), 1))
    w, b = np.zeros(DIMENSIONS), 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(_sums(w, r, d, len(rows)) + b))) - y
        w -= rate * (np.bincount(d, (error * scale)[r], minlength=DIMENSIONS) / len(rows) * 20 + l2 * w)
        b -= rate * error.mean()
    return w, b


@cache
def fitted() -> tuple[np.ndarray, float]:
    """The model of the whole labelled table."""
    return train(labelled())


def score(hosts: list[str], paths: list[str], model: tuple[np.ndarray, float] | None = None) -> np.ndarray:
    """Probability that each URL is to be blocked."""
    w, b = model or fitted()
    return 1 / (1 + np.exp(-(_sums(w, *features(hosts, paths), len(hosts)) + b)))


class RuleBook:
    """Rules by host; the longest that fits a host's suffix and the path's beginning is found."""

    def __init__(self, rules: list[tuple[str, str]]):
        if len(rules) > MOST_RULES:
            raise ValueError(f"at most {MOST_RULES} rules")
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for action, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
            name, prefix = rule.split("/", 1)
            self.by_host.setdefault(name, []).append(("/" + prefix, action, rule))
        self.longest = max(map(len, self.by_host), default=-1)

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(action, rule), or nulls."""
        best: tuple = (None, None)
        at = 0 if len(host) <= self.longest else host.find(".", len(host) - self.longest - 1) + 1
        while at or len(host) <= self.longest:
            for prefix, action, rule in self.by_host.get(host[at:], ()):
                if path.startswith(prefix):
                    if best[1] is None or (-len(rule), rule) < (-len(best[1]), best[1]):
                        best = (action, rule)
                    break
            at = host.find(".", at) + 1
            if not at:
                break
        return best


def host_of(url: Column) -> Column:
    """From the first `://` to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, score, verdict; only ids and URLs are read, nothing is shuffled."""
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col)
    cut = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    # fitted once, here; weights and rules are broadcast
    shared = pages.sparkSession.sparkContext.broadcast((fitted(), RuleBook(RULES if rules is None else rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, book = shared.value
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            scores = score(hosts, paths, model)
            actions, found = zip(*(book.find(h, p) for h, p in zip(hosts, paths, strict=True)), strict=True) if hosts else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(actions, pa.string())], names=["page_id", "host", "path", "rule", "score", "action"])

    scored = cut.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, score double, action string")
    by_model = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", "score", F.coalesce("action", by_model).alias("verdict"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
