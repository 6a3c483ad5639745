"""Language identification in two steps: the family first, then the languages within it pair by pair."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from textmeter.llm.common import keeps_names, settle, store
from textmeter.session import remove

# Families of language codes. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
}

#: Labelled documents a language is learned from: the first ones in a hash order.
SAMPLE = 500
#: Rows ranked for the sample, as a multiple of it: that fewer than the sample are left is out of the question.
SPARE = 4
#: Buckets that character n-grams are hashed to.
BUCKETS = 1 << 12
ORDERS = (1, 2, 3)
#: Characters counted at once.
BLOCK = 1 << 20
PENALTY = 10.0
PASSES = 30
#: Steepness of the logistic curve that turns a margin into a share.
SLOPE = 3.0
UNKNOWN = "und"


def family_of(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language in codes), language)


# --- features ----------------------------------------------------------------

@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of hashed counts: runs of 1 to 3 letters, words bounded by blanks, lower case."""
    counts = np.zeros(BUCKETS, "i8")
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    carried = np.array([32], "u4")
    for first in range(0, len(points), BLOCK):
        block = points[first:first + BLOCK]
        block = np.where(_letters()[block], block, np.uint32(32))
        run = np.concatenate((carried, block, [np.uint32(32)] if first + BLOCK >= len(points) else []))
        # Of a run of other characters one blank stays.
        run = run[np.concatenate(([True], (run[1:] != 32) | (run[:-1] != 32)))].astype("u8")
        for order in ORDERS:
            # Grams that end in this block; the others are counted.
            begin = max(0, len(carried) - order + 1)
            gram = np.zeros(max(0, len(run) - order + 1 - begin), "u8")
            for i in range(order):
                gram = gram * np.uint64(1_000_003) + run[begin + i:begin + i + len(gram)]
            gram = (gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order)) >> np.uint64(40)
            counts += np.bincount((gram % np.uint64(BUCKETS)).astype("i8"), minlength=BUCKETS)
        carried = run[-(max(ORDERS) - 1):].astype("u4")
    weights = np.sqrt(counts)
    return (weights / max(np.linalg.norm(weights), 1e-12)).astype("f4")


# --- linear support vector machine -------------------------------------------

def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, passes: int = PASSES) -> np.ndarray:
    """Weights (the last one is the bias) that minimise |w|^2 / 2 + penalty * hinge losses, by dual coordinate descent.

    ``y`` is 1 or -1; both classes weigh the same in total.
    """
    x = np.hstack((x, np.ones((len(x), 1), "f4")))
    limit = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * penalty
    norm, dual, w = np.einsum("ij,ij->i", x, x), np.zeros(len(x)), np.zeros(x.shape[1], "f4")
    shuffle = np.random.default_rng(len(x))
    for _ in range(passes):
        moved = 0.0
        for i in shuffle.permutation(len(x)):
            gradient = y[i] * float(w @ x[i]) - 1
            new = min(max(dual[i] - gradient / norm[i], 0.0), limit[i])
            step = new - dual[i]
            if step:
                w += np.float32(step * y[i]) * x[i]
                dual[i], moved = new, max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def _models(languages: list[str]) -> list[tuple[str, str, str]]:
    """(kind, a, b) of every machine: each family against the rest, and each pair of languages in a family."""
    families = sorted({family_of(x) for x in languages})
    against_rest = [("family", f, "") for f in families] if len(families) > 1 else []
    pairs = [("pair", a, b) for a, b in itertools.combinations(sorted(languages), 2) if family_of(a) == family_of(b)]
    return against_rest + pairs


def _sides(model: tuple[str, str, str], language: str) -> int:
    kind, a, b = model
    if kind == "family":
        return 1 if family_of(language) == a else -1
    return 1 if language == a else -1 if language == b else 0


# --- learning on Spark -------------------------------------------------------

def held_out(key: str):
    """Whether crc32 of the key as text leaves 1 when divided by 3; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> dict:
    """The fitted machines: {"languages": [...], "machines": {(kind, a, b): weights}}.

    Learns from rows that are not held out, have a language and a letter. Each
    language gives its first ``sample`` texts in a hash order: a bounded sample
    for fitting, whole texts. Keys are ranked without their texts, and only those
    whose hash is small enough for the language's number of rows, so the task that
    ranks a language does not grow with it; the sampled ones, bounded by
    ``sample`` times the number of languages, are then looked up with a broadcast.
    Every machine is fitted in a task of its own; the driver
    receives weights only.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out("key") & F.col("text").rlike(r"\p{L}"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("key", "hash"), "key", "hash")
    named, named_path = store(rows.select("lang", "key", "hash").distinct(), "keys")
    # Proven bound: one row per language.
    sizes = F.broadcast(named.groupBy("lang").agg(F.count("*").alias("n")))
    # Hashes are even: about SPARE times the sample lies below this share, however many rows a language has.
    share = F.xxhash64("key", "hash").cast("double") / 2.0**64 + 0.5
    near = named.join(sizes, "lang").filter(share * F.col("n") <= SPARE * sample)
    near = near.withColumn("place", F.row_number().over(order))
    chosen, _ = store(near.filter(F.col("place") <= sample).select("lang", "key", "hash"), "sample")
    remove(docs.sparkSession, named_path)
    languages = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    models = _models(languages)
    if not models:
        return {"languages": languages, "machines": {}}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"lang": rows["lang"], "key": rows["key"], "hash": rows["hash"], "x": [features(t).tobytes() for t in rows["text"]]})

    # Proven bound: sample rows per language.
    null_safe = F.coalesce(F.col("key"), F.lit(""))
    sampled = rows.withColumn("key", null_safe).join(F.broadcast(chosen.withColumn("key", null_safe)), ["lang", "key", "hash"], "left_semi")
    sampled = sampled.dropDuplicates(["lang", "key", "hash"]).mapInPandas(counted, "lang string, key string, hash long, x binary")
    sampled, _ = store(sampled, "features")

    of = {x: [i for i, m in enumerate(models) if _sides(m, x)] for x in languages}
    takes = F.create_map(*(F.lit(v) for x in languages for v in (x, of[x])))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        model = models[int(rows["model"].iat[0])]
        rows = rows.sort_values(["lang", "key", "hash"])
        x = np.stack([np.frombuffer(b, "f4") for b in rows["x"]])
        y = np.array([_sides(model, v) for v in rows["lang"]])
        return pd.DataFrame({"model": rows["model"].iloc[:1], "w": [fit_svm(x, y).astype("f4").tobytes()]})

    fits = sampled.withColumn("model", F.explode(takes[F.col("lang")])).groupBy("model").applyInPandas(fit, "model int, w binary")
    return {"languages": languages, "machines": {models[r.model]: np.frombuffer(r.w, "f4") for r in fits.collect()}}


# --- prediction --------------------------------------------------------------

class Predictor:
    def __init__(self, model: dict):
        self.languages = model["languages"]
        self.names = list(model["machines"])
        self.weights = np.stack(list(model["machines"].values())) if self.names else np.zeros((0, BUCKETS + 1), "f4")
        self.members: dict[str, list[str]] = {}
        for x in self.languages:
            self.members.setdefault(family_of(x), []).append(x)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        margins = self.weights[:, :-1] @ features(text) + self.weights[:, -1]
        shares = dict(zip(self.names, (1 / (1 + np.exp(-SLOPE * margins.astype("f8")))).tolist()))
        families = sorted(self.members)
        if len(families) > 1:
            by_family = {f: shares["family", f, ""] for f in families}
            family = max(families, key=lambda f: by_family[f])
            score = by_family[family] / sum(by_family.values())
        else:
            family, score = families[0], 1.0
        inside = sorted(self.members[family])
        if len(inside) == 1:
            return inside[0], score

        def against(a, b):
            return shares["pair", a, b] if a < b else 1 - shares["pair", b, a]

        # Most duels won; among equals the larger mean share.
        duels = {a: [against(a, b) for b in inside if b != a] for a in inside}
        best = max(inside, key=lambda a: (sum(d > 0.5 for d in duels[a]), sum(duels[a])))
        return best, score * sum(duels[best]) / len(duels[best])


@keeps_names
def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from the whole text alone.

    A family is predicted by machines that tell each family from the rest; then
    one machine per pair of its languages decides. ``score`` is the family's
    share times the mean share of the language in its duels. A null text, or one
    without a letter, is ``und`` with score 0, and so is every text if nothing
    was learned. Rows pass through as they are; columns named ``lang_pred`` or
    ``score`` are replaced. An empty table gives an empty table.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(shipped.value)
        for texts in batches:
            yield pd.DataFrame([predictor.predict(t) for t in texts], columns=["lang_pred", "score"])
        settle()

    found = docs.withColumn("__found", predicted(F.col(text)))
    return found.withColumn("lang_pred", F.col("__found.lang_pred")).withColumn("score", F.col("__found.score")).drop("__found")
