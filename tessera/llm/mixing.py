"""Sources mixed to target weights by iterative proportional fitting.

Texts are counted into cells of source, language and topic. Raking finds a weight per cell so that the weighted tokens meet the
targets of the sources and, as far as the repeats allow, the corpus's own shares of languages and topics. Every text is then
taken floor(weight) times, and once more if its hashed number is below a threshold that is set per cell by the tokens that are
still due; thresholds come from a histogram of all texts.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import strip
from tessera.llm.tokens import VOCABULARY, Counter_, ranks_of
from tessera.session import bounded, cut, spread

# Words in a court's name that tell what it deals with.
TOPICS = (
    ("employment", ("employment", "labour", "arbeitsgericht", "prud'hommes", "prud’hommes")),
    ("family", ("family", "familien", "familiales")),
    ("land", ("land tribunal", "lands", "foncier")),
    ("commercial", ("commercial", "handels", "commerce")),
    ("administrative", ("administrative", "verwaltungs", "administratif")),
    ("supreme", ("supreme", "bundesgericht", "suprême", "cassation")),
    ("appeal", ("appeal", "oberlandes", "appel")),
)


def source_key(c: str) -> Column:
    """A source's name as it is compared: stripped, lower case, hyphens and blanks as underscores."""
    return F.translate(F.lower(strip(c)), "- ", "__")


def topic(c: str) -> Column:
    """What a court deals with, by its name; civil if nothing tells, unknown if it is null."""
    out = F.when(F.col(c).isNull(), F.lit("unknown"))
    for name, words in TOPICS:
        low = F.lower(F.col(c))
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit("civil"))


#: Labelled documents that the language model is fitted on, those of least hashed id; frequent words of each language that it keeps.
LANGUAGE_DOCUMENTS, LANGUAGE_WORDS = 900, 400


@dataclass(frozen=True)
class Languages:
    """A naive Bayes model of languages over the distinct words of a text: names, and per word its ln probability in each."""

    names: tuple[str, ...]
    words: dict[str, tuple[float, ...]]

    def __call__(self, text: str | None, label: str | None) -> str:
        """The language of a text: its label, cleaned, unless that is missing, unknown or plainly contradicted; unknown if nothing tells."""
        label = clean_label(label)
        sums = [0.0] * len(self.names)
        for w in set((text or "").lower().split()):
            v = self.words.get(w)
            if v:
                sums = [a + b for a, b in zip(sums, v)]
        if not any(sums):
            return label or "unknown"
        best = max(range(len(sums)), key=lambda k: (sums[k], self.names[k]))
        if label in self.names and sums[best] - sums[self.names.index(label)] < CONTRADICTED:
            return label
        return self.names[best]


#: By how much, in ln, another language must be likelier for a label not to be believed.
CONTRADICTED = 10.0


def clean_label(label: str | None) -> str | None:
    """A language label in lower case without white space; null for null and blank."""
    return (label or "").strip().lower() or None


def fit_languages(documents: DataFrame, sample: int = LANGUAGE_DOCUMENTS) -> Languages:
    """The model of a bounded sample of labelled documents. Labels that hold less than a fiftieth of the sample are taken for mistakes."""
    rows = documents.where("doc_id is not null and text is not null and trim(lang) <> ''").select("doc_id", "lang", "text")
    ids = [r.doc_id for r in rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    got = rows.where(F.col("doc_id").isin(ids)).dropDuplicates(["doc_id"]).collect() if ids else []
    seen: dict[str, Counter] = defaultdict(Counter)
    for r in got:
        seen[clean_label(r.lang)].update(set(r.text.lower().split()))
    size = Counter(clean_label(r.lang) for r in got)
    names = tuple(sorted(k for k, n in size.items() if n * 50 >= len(got)))
    vocabulary = {w for k in names for w, _ in sorted(seen[k].items(), key=lambda x: (-x[1], x[0]))[:LANGUAGE_WORDS]}
    return Languages(names, {w: tuple(math.log((seen[k][w] + 0.5) / (size[k] + 1.0)) for k in names) for w in vocabulary})


def profiles(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per distinct text: doc_id (the least of its copies), source, lang, topic, n_tokens; the source is that doc_id's.

    Rows without doc_id, and null and empty texts, are left out: they hold no tokens. Copies are found by a 128-bit digest. The language
    is that of the label, or of a model fitted on labelled documents where the label is missing or plainly wrong.
    """
    held = documents.sparkSession.sparkContext.broadcast((ranks_of(vocabulary), fit_languages(documents)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, language = held.value
        count = Counter_(ranks)
        for b in batches:
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "digest": b["digest"], "source": b["source"], "topic": b["topic"],
                "lang": [language(x, k) for x, k in zip(b["text"], b["lang"])], "n_tokens": [count(x) for x in b["text"]],
            })

    rows = documents.where("doc_id is not null and text is not null and text <> ''").select(
        "doc_id", source_key("source").alias("source"), "lang", topic("court").alias("topic"), "text", F.md5("text").alias("digest")
    )
    out = spread(rows).mapInPandas(run, "doc_id bigint, digest string, source string, topic string, lang string, n_tokens bigint")
    return out.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "lang", "topic", "n_tokens")).alias("v")).select("v.*").where("n_tokens > 0")


@dataclass(frozen=True)
class Cell:
    source: str
    lang: str
    topic: str
    tokens: int


def rake(cells: list[Cell], shares: dict[str, float], repeats: dict[str, int], rounds: int = 200) -> tuple[dict[Cell, float], int]:
    """Weights per cell, none above its source's repeats, and the total they add up to.

    The total is the largest that every source with texts can hold its share of. Source targets are met exactly; languages and
    topics are drawn towards their shares in the listed sources' own tokens, as far as the repeats leave room.
    """
    cells = [c for c in cells if shares.get(c.source, 0) > 0 and repeats.get(c.source, 0) > 0 and c.tokens > 0]
    own: dict[str, int] = defaultdict(int)
    for c in cells:
        own[c.source] += c.tokens
    if not own:
        return {}, 0
    held = sum(shares[s] for s in own)
    part = {s: shares[s] / held for s in own}
    total = min(repeats[s] * own[s] / part[s] for s in own)
    goal = {("source", s): part[s] * total for s in own}
    everything = sum(own.values())
    for axis in ("lang", "topic"):
        for c in cells:
            goal[axis, getattr(c, axis)] = goal.get((axis, getattr(c, axis)), 0.0) + c.tokens / everything * total
    w = {c: 1.0 for c in cells}
    for _ in range(rounds):
        for axis in ("topic", "lang", "source"):
            groups: dict[str, list[Cell]] = defaultdict(list)
            for c in cells:
                groups[getattr(c, axis)].append(c)
            for g, members in groups.items():
                for _ in range(len(members) + 1):  # cells at their limit stay there, the others make up for them
                    free = [c for c in members if w[c] < repeats[c.source]]
                    due = goal[axis, g] - sum(w[c] * c.tokens for c in members if w[c] >= repeats[c.source])
                    now = sum(w[c] * c.tokens for c in free)
                    if axis != "source":
                        due, now = goal[axis, g], sum(w[c] * c.tokens for c in members)
                        free = members
                    if now <= 0 or due <= 0:
                        break
                    f = due / now
                    for c in free:
                        w[c] = min(float(repeats[c.source]), w[c] * f)
                    if axis != "source" or abs(sum(w[c] * c.tokens for c in members) - goal[axis, g]) <= 1e-9 * total:
                        break
    return w, int(total)


def _limits(edges: list[tuple[str, str, str, int, int, int, float]], bins: int) -> list[tuple[str, str, str, float]]:
    """Where each cell's extra copies end: before or after the bin in which its due tokens lie.

    What a cell gets too much or too little goes on to the next cell of its source, the finest last.
    """
    out, carry = [], defaultdict(float)
    for source, lang, about, at, before, tokens, due in sorted(edges, key=lambda e: (e[0], -e[5], e[1], e[2])):
        want = due + carry[source]
        take = abs(before + tokens - want) <= abs(before - want)
        carry[source] = want - before - tokens * take
        out.append((source, lang, about, (at + take) / bins))
    return out


#: Listed sources that reach the driver at most.
SOURCES = 10_000


def selection(texts: DataFrame, targets: DataFrame, bins: int = 4096) -> DataFrame:
    """The selected texts: doc_id, source, lang, topic, n_tokens, copies (1 to the source's max_repeats).

    texts: as from `profiles`. targets: source, target_share, max_repeats (few rows). Sources that aren't listed, and listed ones
    without a share or repeats, give nothing; shares of listed sources without texts are spread over the others in proportion.
    """
    texts = cut(texts.select("doc_id", "source", "lang", "topic", "n_tokens"), "texts")
    want = targets.select(source_key("source").alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0")
    want = bounded(want, SOURCES, "source_targets")
    shares, repeats = {r.source: float(r.target_share) for r in want}, {r.source: int(r.max_repeats) for r in want}
    listed = texts.where(F.col("source").isin(list(shares)))
    cells = [Cell(r.source, r.lang, r.topic, int(r.tokens)) for r in listed.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")).collect()]
    weights, _ = rake(cells, shares, repeats)
    spark = texts.sparkSession
    rows = [(c.source, c.lang, c.topic, int(w + 1e-9), float(max(0.0, w - int(w + 1e-9)) * c.tokens)) for c, w in weights.items()]
    plan = spark.createDataFrame(rows, "source string, lang string, topic string, base int, due double")
    at = listed.join(F.broadcast(plan), ["source", "lang", "topic"]).withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    at = at.withColumn("bin", F.floor(F.col("u") * bins))
    keys = ["source", "lang", "topic"]
    per = at.groupBy(*keys, "bin", "due").agg(F.sum("n_tokens").alias("tokens"))  # a histogram, at most `bins` rows a cell
    w = Window.partitionBy(*keys).orderBy("bin")
    per = per.withColumn("upto", F.sum("tokens").over(w)).withColumn("before", F.col("upto") - F.col("tokens"))
    edges = per.where("due > before and due <= upto").select(*keys, "bin", "before", "tokens", "due").collect()  # at most a row a cell
    limits = spark.createDataFrame(_limits([tuple(e) for e in edges], bins), "source string, lang string, topic string, limit double")
    return (
        at.join(F.broadcast(limits), keys, "left")  # at most a row a cell
        .withColumn("copies", (F.col("base") + F.when(F.col("u") < F.coalesce("limit", F.lit(0.0)), 1).otherwise(0)).cast("int"))
        .where("copies > 0")
        .select("doc_id", *keys, "n_tokens", "copies")
    )


def reached(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target_share, max_repeats, texts, tokens (copies counted), reached_share, most_copies."""
    want = targets.select(source_key("source").alias("source"), "target_share", "max_repeats").where("source is not null")
    per = selected.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    whole = F.sum("tokens").over(Window.partitionBy())  # a few rows, one a source
    return (
        want.join(per, "source", "left")
        .fillna(0, ["texts", "tokens", "most_copies"])
        .select("source", "target_share", "max_repeats", "texts", "tokens", F.when(whole > 0, F.col("tokens") / whole).alias("reached_share"), "most_copies")
    )
