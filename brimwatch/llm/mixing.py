"""Mixing sources to target weights by iterative proportional fitting (operator 8).

Documents fall into cells (source, language, topic) with so many tokens. The
cells' token weights are raked: scaled to the target of each source, then of
each language, then of each topic, and again, until all three hold at once.
Weight over tokens, scaled to at most one, is the probability with which the
cell's documents are drawn, so that the drawn tokens have the target shares.

Over the highest weight, the rarest cell sets how much is drawn. With a stated
share of the tokens (the pipeline's way) probabilities are clipped at one
instead, and the cells that are not clipped are raked on until the marginals hold.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brimwatch.llm.common import stage, unstage

DIMENSIONS = ("source", "lang", "topic")
#: Shares of tokens are raised to this power where no target is named: rare values gain.
TEMPER = 0.7
SWEEPS = 8
#: Sweeps whose plan is run at once.
AT_ONCE = 4
#: With a stated share: part of all tokens that is drawn, and the sweeps.
SHARE = 0.5
WITHIN_SWEEPS = 16
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"
#: A word that ends in three equal marks, and a cell border.
NOISE, BORDER = r"[%&#*$]{3}(?=[\x20\x09-\x0D]|$)", r"[\x20\x09-\x0D]\|(?=[\x20\x09-\x0D]|$)"


def topic(text: Column, tokens: Column) -> Column:
    """Kind of content: ``table`` or ``markup`` if a tenth of the words are borders or marks, else by length."""
    return (
        F.when(10 * F.regexp_count(text, F.lit(BORDER)) >= F.greatest(tokens, F.lit(1)), "table")
        .when(10 * F.regexp_count(text, F.lit(NOISE)) >= F.greatest(tokens, F.lit(1)), "markup")
        .when(tokens < 200, "note")
        .otherwise("article")
    )


def described(docs: DataFrame) -> DataFrame:
    """doc_id, tokens (words of the whole text), source, lang, topic; a null value is a category of its own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
        text.alias("text"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
    )
    return counted.select("doc_id", "tokens", "source", "lang", topic(F.col("text"), F.col("tokens")).alias("topic"))


def _with_targets(
    cells: DataFrame, dimensions: tuple[str, ...], targets: Mapping[str, Mapping[str, float]], temper: float
) -> DataFrame:
    """Add the target share of the cell's value for every dimension."""
    for name in dimensions:
        marginal = cells.groupBy(name).agg(F.sum("tokens").alias("m"))
        if name in targets:
            pairs = [F.lit(x) for item in targets[name].items() for x in item]
            marginal = marginal.withColumn("p", F.coalesce(F.element_at(F.create_map(*pairs), F.col(name)), F.lit(0.0)))
        else:
            marginal = marginal.withColumn("p", F.pow(F.col("m").cast("double"), F.lit(temper)))
        whole = marginal.where("m > 0").agg(F.sum("p")).first()[0] or 1.0  # one number
        share = F.when(F.col("m") > 0, F.col("p") / F.lit(whole)).otherwise(0.0)
        cells = cells.join(marginal.select(name, share.alias(f"share_{name}")), name)
    return cells


def rake(
    cells: DataFrame,
    dimensions: tuple[str, ...] = DIMENSIONS,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    temper: float = TEMPER,
    sweeps: int = SWEEPS,
) -> DataFrame:
    """Rake ``cells`` (one row per combination, with ``tokens``) to the marginals; adds ``weight``.

    ``targets`` names relative weights by dimension and value; values it leaves
    out get none. A dimension it leaves out gets its own shares, tempered. The
    work is on cells and does not grow with documents.
    """
    now = stage(_with_targets(cells, dimensions, targets or {}, temper), "cells")
    total = float(now.agg(F.sum("tokens")).first()[0] or 0)
    rows = now.withColumn("weight", F.col("tokens").cast("double"))
    for sweep in range(1, sweeps + 1):
        for name in dimensions:
            held = F.sum("weight").over(W.partitionBy(name))
            rows = rows.withColumn(
                "weight",
                F.when(held > 0, F.col("weight") * F.col(f"share_{name}") * F.lit(total) / held).otherwise(0.0),
            )
        if sweep % AT_ONCE == 0 or sweep == sweeps:
            after = stage(rows, "raked")
            unstage(now)
            now = rows = after
    return now.drop(*(f"share_{name}" for name in dimensions))


def _wanted(cells: DataFrame, name: str, budget: float) -> DataFrame:
    """Tokens to draw of each value: in proportion to its share, of a value with fewer tokens all, ``budget`` in all."""
    values = cells.groupBy(name).agg(F.sum("tokens").alias("m"), F.first(f"share_{name}").alias("p"))
    level = 0.0
    while True:  # rises to the level in as many steps as there are turns of values that run out
        full = F.col("m") <= F.lit(level) * F.col("p")
        used, rest = values.agg(F.sum(F.when(full, F.col("m"))), F.sum(F.when(~full, F.col("p")))).first()
        after = (budget - float(used or 0)) / rest if rest else level
        if after <= level * (1 + 1e-12):
            break
        level = after
    level = level if rest else float("inf")
    return values.select(name, F.least(F.col("m").cast("double"), F.lit(level) * F.col("p")).alias(f"want_{name}"))


def rake_within(
    cells: DataFrame,
    dimensions: tuple[str, ...] = DIMENSIONS,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    temper: float = TEMPER,
    share: float = SHARE,
    sweeps: int = WITHIN_SWEEPS,
) -> DataFrame:
    """Rake ``cells`` to ``share`` of all tokens, of no cell more than it has; adds ``weight``, the tokens to draw.

    Targets are as in ``rake``. A value without enough tokens for its share gives
    all it has, the others make up for it. Cells of a value whose share is 0 give
    none; if what is left is less than ``share``, all of that is drawn.
    """
    shared = stage(_with_targets(cells, dimensions, targets or {}, temper), "cells")
    total = float(shared.agg(F.sum("tokens")).first()[0] or 0)
    able = F.col("tokens") > 0
    for name in dimensions:
        able = able & (F.col(f"share_{name}") > 0)
    rows = shared.where(able)
    budget = min(share * total, float(rows.agg(F.sum("tokens")).first()[0] or 0))
    for name in dimensions:
        rows = rows.join(_wanted(shared.where(able), name, budget), name)
    # ``free`` is the weight without the bound: a clipped cell can fall below it again.
    now = rows = stage(rows.drop(*(f"share_{n}" for n in dimensions)).withColumn("free", F.col("tokens").cast("double")), "able")
    for sweep in range(1, sweeps + 1):
        for name in dimensions:
            value = W.partitionBy(name)
            # If this cell and those that reach the bound later stay free, the rest being clipped.
            later = value.orderBy((F.col("tokens") / F.col("free")).desc(), *dimensions)
            later = later.rowsBetween(W.unboundedPreceding, W.currentRow)
            clipped = F.sum("tokens").over(value) - F.sum("tokens").over(later)
            rows = rows.withColumn("factor", (F.col(f"want_{name}") - clipped) / F.sum("free").over(later))
            # Clipping any cell can only lower the sum, so the largest factor is the one that holds.
            rows = rows.withColumn("free", F.col("free") * F.max("factor").over(value)).drop("factor")
        if sweep % AT_ONCE == 0 or sweep == sweeps:
            after = stage(rows, "raked")
            unstage(now)
            now = rows = after
    drawn = now.select(*dimensions, F.least("free", F.col("tokens").cast("double")).alias("weight"))
    out = shared.drop(*(f"share_{n}" for n in dimensions)).join(drawn, list(dimensions), "left")
    return out.withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def mix_sources(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    seed: int = 0,
    sweeps: int = SWEEPS,
    share: float | None = None,
) -> DataFrame:
    """One row per document: doc_id, tokens, source, lang, topic, probability, kept.

    The probability is the raked weight per token of the document's cell, over the
    highest one (as in the SQL: the rarer the rarest cell, the less is drawn). With
    ``share``, that part of all tokens is drawn, whatever the rarest cell; ``sweeps``
    does not count then. Documents are drawn by a hash of doc_id and ``seed``, so the draw
    can be repeated and does not depend on the other rows. Documents of cells
    without tokens (null, empty or white texts) have probability 0. Rows that repeat
    a doc_id are drawn alike.
    """
    # The texts are read once; what follows works on these few columns.
    rows = stage(described(docs), "described")
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    raked = rake(cells, targets=targets, sweeps=sweeps) if share is None else rake_within(cells, targets=targets, share=share)
    raked = raked.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    highest = 1.0 if share is not None else raked.agg(F.max("ratio")).first()[0] or 1.0  # one number
    rated = raked.select(*DIMENSIONS, (F.col("ratio") / F.lit(highest)).alias("p"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}"))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return rows.join(rated, list(DIMENSIONS)).select(
        "doc_id", "tokens", *DIMENSIONS, F.round("p", 9).alias("probability"), (draw < F.col("p")).alias("kept")
    )


def sql(seed: int = 0, sweeps: int = SWEEPS, temper: float = TEMPER) -> str:
    """The same in DuckDB SQL, one table per raking step."""
    names = ", ".join(DIMENSIONS)
    parts = [
        rf"""a AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
         coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
  FROM documents
), b AS MATERIALIZED (
  SELECT doc_id, tokens, source, lang,
         CASE WHEN 10 * len(regexp_extract_all(regexp_replace(text, '[\x20\x09-\x0D]', '  ', 'g') || ' ',
                                               '[\x20]\|[\x20]')) >= greatest(tokens, 1) THEN 'table'
              WHEN 10 * len(regexp_extract_all(regexp_replace(text, '[\x20\x09-\x0D]', ' ', 'g') || ' ',
                                               '[%&#*$][%&#*$][%&#*$]\x20')) >= greatest(tokens, 1) THEN 'markup'
              WHEN tokens < 200 THEN 'note' ELSE 'article' END AS topic
  FROM a
), c AS (SELECT {names}, sum(tokens)::DOUBLE AS tokens FROM b GROUP BY ALL)"""
    ]
    for name in DIMENSIONS:
        parts.append(
            f"m_{name} AS (SELECT {name}, pow(sum(tokens), {temper}) AS p FROM c GROUP BY {name}), "
            f"s_{name} AS (SELECT {name}, p / (SELECT sum(p) FROM m_{name}) AS share_{name} FROM m_{name})"
        )
    joined = " ".join(f"JOIN s_{name} USING ({name})" for name in DIMENSIONS)
    parts.append(f"r0 AS MATERIALIZED (SELECT *, tokens AS w, sum(tokens) OVER () AS whole FROM c {joined})")
    step = 0
    for _ in range(sweeps):
        for name in DIMENSIONS:
            parts.append(
                f"r{step + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {name}) > 0 "
                f"THEN w * share_{name} * whole / sum(w) OVER (PARTITION BY {name}) ELSE 0 END AS w) FROM r{step})"
            )
            step += 1
    parts.append(
        f"q AS (SELECT {names}, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS ratio FROM r{step}), "
        f"p AS (SELECT {names}, ratio / (SELECT max(ratio) FROM q) AS p FROM q)"
    )
    draw = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|{seed}'), 1, 8))::BIGINT / 4294967296.0"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, tokens, {names}, round(p, 9) AS probability, {draw} < p AS kept "
        f"FROM b JOIN p USING ({names})"
    )
