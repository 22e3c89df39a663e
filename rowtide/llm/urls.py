"""URL filters: rules for hosts and paths, and for the rest a logistic regression on hashed character n-grams.

The regression is trained on the n-grams of host and path of a small labelled URL table (``labelled_urls``, or the
caller's own; at most ``MOST_LABELLED`` rows are read). The table is made by a rule from words that are common in the names
of bad and of good sites, alone and in pairs; every fifth host is held out to measure accuracy. A url that is null or has
no ``://`` has an empty host and path, fits no rule, and is allowed.

Repeated rows are judged each, and rows with one page_id and different urls too; the longest rule wins, and of rules of
one length, which can't both fit, none is preferred. A very long url is judged whole, by one task. Other columns are
kept, but those named as the results are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import common

BINS, GRAMS, MOST_LABELLED = 1 << 15, (3, 4, 5), 20_000
#: (verdict, host, path); a rule's name is its host and path together.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
# Words in names of sites to block, of sites to allow, and of both.
BAD = """casino poker slots bet bets betting bingo jackpot roulette gambling lottery viagra cialis pills pill meds pharma steroids
porn porno sex sexy xxx adult nude cams escort hookup erotic malware virus trojan phishing spam spammer crack warez torrent
keygen hacks botnet payday loans cash prizes prize win winner free click clicks ads adserver track tracker popunder cheap
replica fake miracle""".split()
GOOD = """library museum weather history science garden kitchen research school university railway theatre village painting
travel music county council archive health data tools train times book sun dial house river mountain city town church farm
academy gallery journal press review radio college family society institute lake valley island forest coffee bakery
restaurant hotel design studio photo film cinema sport football cycling walking bird nature planet ocean energy law clinic
dental doctor hospital parents teacher language english poetry story letters stone bridge castle rose lily betsy ross anna
smith miller peter maria recipes wiki docs games linux python""".split()
BOTH = "shop online live download web site store best top my hub center world zone blog portal group club news link links forum open host server".split()
DOMAINS = ["com", "net", "org", "info", "example.com", "example.net", "example.org", "co.uk", "de", "fr", "es", "ru", "io"]
#: Frequent groups of letters, for made-up names of sites to allow.
GROUPS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ing ion tion ent".split()


def labelled_urls(size: int = 6000, held_out: bool = False) -> list[tuple[str, int]]:
    """(host and path, 1 to block): the rows to learn from, or those of every fifth host, which are held out."""
    rng, rows, seen = random.Random(11), [], set()
    while len(seen) < size:
        label = rng.randrange(2)
        words = BAD if label else GOOD
        kind = rng.randrange(5)
        if not label and rng.random() < 0.4:  # a made-up name
            name = "".join(rng.choice(GROUPS) for _ in range(rng.randrange(2, 5)))
        elif kind < 2:
            name = rng.choice(words)
        else:
            both = [rng.choice(words), rng.choice(words if kind == 2 else BOTH)]
            rng.shuffle(both)
            name = rng.choice(["-", ""]).join(both)
        host = rng.choice(["", "", "www.", "blog.", "m.", "en."]) + name + rng.choice(["", "", "", "1", "24"]) + "." + rng.choice(DOMAINS)
        path = rng.choice(["", "/", "/index.html", f"/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(1000)}", f"/{rng.choice(BOTH)}/{rng.choice(GOOD)}", f"/{rng.randrange(10**4)}.html"])
        if host not in seen:
            seen.add(host)
            if (len(seen) % 5 == 0) == held_out:
                rows.append((host + path, label))
    return rows


def grams(texts: pa.Array, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the distinct n-grams of each text, hashed to ``bins`` places; an empty text has place 0."""
    data, offsets = common.text_buffer(pc.binary_join_element_wise("^", texts, "$", ""))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    code, found = data.astype(np.uint64), []
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint64(257) + data[n - 1 :]
        if n in GRAMS:
            inside = row[: len(code)] == row[n - 1 :]
            found.append(row[: len(code)][inside] * bins + (common.mixed(code[inside] + np.uint64(n)) % np.uint64(bins)).astype(np.int64))
    found.append(np.flatnonzero(np.diff(offsets) == 2) * bins)
    return np.divmod(np.unique(np.concatenate(found)), bins)


def learn(rows: list[tuple[str, int]], bins: int = BINS, ridge: float = 1e-2, rounds: int = 200) -> np.ndarray:
    """Weights of the n-grams, the bias last; both labels weigh the same."""
    rows = rows[:MOST_LABELLED]
    w = np.zeros(bins + 1)
    if not rows:
        return w
    y = np.array([label for _, label in rows], float)
    each = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    row, at = grams(pa.array([text for text, _ in rows], pa.string()), bins)
    value = (1 / np.sqrt(np.bincount(row, minlength=len(rows))))[row]
    ahead = w
    for k in range(rounds):  # accelerated gradient steps
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, ahead[at] * value, len(rows)) + ahead[-1], -40, 40)))
        gap = each * (p - y)
        new = ahead - 4 * np.append(np.bincount(at, gap[row] * value, bins) + ridge / len(rows) * ahead[:-1], gap.sum())
        new[-1] = min(new[-1], -0.1)
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


def blocked(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Whether the regression blocks each host and path."""
    row, at = grams(texts, len(weights) - 1)
    size = np.bincount(row, minlength=len(texts))
    return np.bincount(row, weights[at], len(texts)) / np.sqrt(np.maximum(size, 1)) + weights[-1] >= 0


def parsed(url: str = "url") -> dict:
    """host and path as columns."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))}


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, weights: np.ndarray | None = None, url: str = "url") -> DataFrame:
    """All columns of ``pages`` but those named host, path, rule and verdict, and these four."""
    weights = learn(labelled_urls()) if weights is None else weights
    held = pages.sparkSession.sparkContext.broadcast(weights)
    made = pages.withColumns(parsed(url))
    rule = verdict = F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last to fit, and so the longest, wins
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    made = made.withColumns({"rule": rule, "verdict": verdict})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            at = batch.schema.names.index("verdict")
            host, path, said = (batch.column(batch.schema.names.index(n)) for n in ("host", "path", "verdict"))
            block = blocked(pc.binary_join_element_wise(host, path, ""), w) & (pc.binary_length(host).to_numpy(zero_copy_only=False) > 0)
            own = pc.if_else(pa.array(block), "block", "allow")
            yield batch.set_column(at, "verdict", pc.coalesce(said, own))

    return made.mapInArrow(run, made.schema)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
