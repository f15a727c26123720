"""Quantities recorded in different units, brought to single units of the reporting currency.

Plan
1. the amount text is read once by built-in expressions: number, unit word,
   currency word (operators.rejects.with_amount).
2. the unit is the one named in the text, else unit_scale. Where both are
   missing, a calibrated tree ensemble names the unit that magnitude, source,
   category and the neighbouring fields suggest. It is trained on a bounded
   sample of rows that state their unit (TRAINING_ROWS), drawn in a fixed order;
   the neighbours are the mean log amounts of the issuer's and of the source's
   other rows, two aggregates of all rows which combine before they shuffle.
   Only rows without a unit meet the model.
3. an assignment whose calibrated probability reaches CONFIDENT is converted,
   every other one is routed for review. What an unsettled row counts as is the
   caller's choice: nothing (`settle="model"`: its amount stays null), or what
   the delivery's own rule says, by which a missing scale means single units
   (`settle="rule"`). Then the rule sets every unit, and the model the route
   alone: a confident assignment that contradicts the rule is for review too.
   Who asks for amounts by the rule and no route takes by_rule(), without a model.
4. the currency is the one in its column, else the one in the text, else the
   issuer's; the rate is the delivered one, else that of the month.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.operators.forest import Forest
from quernstone.operators.rejects import CURRENCY_WORDS, UNIT_WORDS, is_unknown, with_amount
from quernstone.operators.tickers import clean_ticker
from quernstone.session import settled

#: Upper bound of the labelled rows that train the classifier.
TRAINING_ROWS = 12_000
#: Calibrated probability from which a predicted unit is taken over.
CONFIDENT = 0.9
#: Two sources agree if their amounts differ by at most this share of the larger.
TOLERANCE = 0.005


def _lookup(word: Column, groups: dict) -> Column:
    pairs = [(w.lower(), v) for v, ws in groups.items() for w in ws]
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])
    return F.try_element_at(table, F.lower(word))


def _currency(word: Column) -> Column:
    return _lookup(F.regexp_replace(word, r"(?U)\s+", ""), {k: tuple({k, *v}) for k, v in CURRENCY_WORDS.items()})


def unit_value(word: Column) -> Column:
    """The number that a unit's word stands for; null for no or another word."""
    return _lookup(word, {u: w for u, w in UNIT_WORDS.items()})


def read_amounts(valuations: DataFrame, companies: DataFrame, fx: DataFrame) -> DataFrame:
    """One row per loadable, known amount, with what it states.

    Columns: valuation_id, run_id, ticker, snapshot_date, provider, cap_scope,
    market, number, unit_stated, currency, reporting_currency, rate. Rows whose
    market_cap is unknown, or states no single amount above 0, are left out.
    An issuer that companies does not have reports in the row's currency. A
    unit_scale that is not a finite number above 0 counts as missing. Extra columns are
    ignored.
    """
    read = valuations.select(
        "valuation_id", "run_id", "ticker", "snapshot_date", "provider", "cap_scope", "market_cap", "unit_scale", "currency", "fx_to_reporting",
    ).where(~is_unknown(F.col("market_cap")))
    parsed = with_amount(read, "market_cap").select(
        "valuation_id", "run_id", clean_ticker("ticker").alias("ticker"), "snapshot_date", "provider", "cap_scope",
        "number", unit_value(F.col("unit_word")).alias("unit_text"),
        F.when((F.col("unit_scale") > 0) & (F.col("unit_scale") < float("inf")), F.col("unit_scale")).alias("unit_scale"),
        F.coalesce(_currency(F.col("currency")), _currency(F.col("currency_word"))).alias("own_currency"), "fx_to_reporting",
    )
    # written before it is filtered: a filter on the number would be pushed to the scan, and every text
    # read twice; statistics, training sample and scoring then read the narrow result
    v = settled(parsed).where("number is not null")
    c = companies.select(clean_ticker("ticker").alias("ticker"), "market", F.upper("reporting_currency").alias("reporting_currency")).dropDuplicates(["ticker"])
    r = fx.select(F.col("rate_month"), F.upper("from_currency").alias("currency"), F.upper("to_currency").alias("reporting_currency"), "rate").dropDuplicates(["rate_month", "currency", "reporting_currency"])
    x = v.join(c, "ticker", "left").withColumn("currency", F.coalesce("own_currency", "reporting_currency"))
    x = x.withColumn("reporting_currency", F.coalesce("reporting_currency", "currency")).withColumn("rate_month", F.to_date(F.trunc("snapshot_date", "month")))
    x = x.join(r, ["rate_month", "currency", "reporting_currency"], "left")
    fx_own = F.when((F.col("fx_to_reporting") > 0) & (F.col("fx_to_reporting") < float("inf")), F.col("fx_to_reporting"))
    rate = F.when(F.col("currency").eqNullSafe(F.col("reporting_currency")), F.lit(1.0)).otherwise(F.coalesce(fx_own, F.col("rate")))
    return x.select(
        "valuation_id", "run_id", "ticker", "snapshot_date", "provider", "cap_scope", "market", "number",
        F.coalesce("unit_text", "unit_scale").alias("unit_stated"), "currency", "reporting_currency", rate.alias("rate"),
    )


# -- the classifier ----------------------------------------------------------

_FEATURES = "log_number, digits_after, provider_code, scope_code, market_code, currency_code, ticker_gap, provider_gap".split(", ")


def _neighbours(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ticker, sum and number of log amounts of stated unit) and the same by provider."""
    stated = F.when(F.col("unit_stated").isNotNull(), F.log10("number") + F.log10("unit_stated"))
    cells = x.groupBy("ticker", "provider").agg(F.sum(stated).alias("total"), F.count(stated).alias("n"))
    by = lambda key: cells.groupBy(key).agg(F.sum("total").alias(f"{key}_sum"), F.sum("n").alias(f"{key}_n"))
    return by("ticker"), by("provider")


def _with_features(x: DataFrame, neighbours: tuple[DataFrame, DataFrame]) -> DataFrame:
    """x with what the model looks at; no row is its own neighbour."""
    log = F.log10("number")
    own, one = F.coalesce(log + F.log10("unit_stated"), F.lit(0.0)), F.col("unit_stated").isNotNull().cast("int")
    gap = lambda key: F.try_divide(F.coalesce(f"{key}_sum", F.lit(0.0)) - own, F.nullif(F.coalesce(f"{key}_n", F.lit(0)) - one, F.lit(0))) - log
    code = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(1021)).cast("double")
    tickers, providers = neighbours
    y = x.join(tickers, "ticker", "left").join(providers, "provider", "left")
    return y.withColumns({
        "log_number": log, "digits_after": (F.col("number") % 1 > 0).cast("double"), "provider_code": code("provider"), "scope_code": code("cap_scope"),
        "market_code": code("market"), "currency_code": code("currency"), "ticker_gap": gap("ticker"), "provider_gap": gap("provider"),
    }).drop("ticker_sum", "ticker_n", "provider_sum", "provider_n")


def train_units(x: DataFrame, neighbours: tuple[DataFrame, DataFrame], *, rows: int = TRAINING_ROWS, seed: int = 1) -> Forest | None:
    """A forest from at most `rows` rows that state their unit: the first ones in the order of a hash of their id.

    The same rows are drawn however the data are partitioned. None if no row
    states a unit.
    """
    place = F.xxhash64("valuation_id", F.lit(seed))
    drawn = x.where(F.col("unit_stated").isNotNull()).orderBy(place, "valuation_id", "number", "unit_stated").limit(rows)
    got = _with_features(drawn, neighbours).select("valuation_id", "unit_stated", "number", *_FEATURES).toPandas().sort_values(["valuation_id", "number", "unit_stated"])
    if got.empty:
        return None
    return Forest.fit(got[_FEATURES].to_numpy(float), got["unit_stated"].to_numpy(float), seed=seed)


def assign_units(x: DataFrame, *, confident: float = CONFIDENT, settle: str = "rule") -> DataFrame:
    """x with unit, unit_model, unit_confidence, route ('stated', 'model' or 'review').

    settle: what a row for review counts as, 'model' for no unit at all, 'rule'
    for the single units of the delivery's rule.
    """
    if settle not in ("model", "rule"):
        raise ValueError("settle is 'model' or 'rule'")
    neighbours = _neighbours(x)
    model = train_units(x, neighbours)
    blob = pickle.dumps(model) if model is not None else None
    asked = _with_features(x.where(F.col("unit_stated").isNull()), neighbours)
    # a mean of doubles depends on the order of its sum in the last places; the model must not
    asked = asked.withColumns({c: F.round(c, 9) for c in ("log_number", "ticker_gap", "provider_gap")})
    schema = T.StructType([*asked.schema.fields, T.StructField("unit_model", T.DoubleType()), T.StructField("unit_confidence", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = pickle.loads(blob) if blob else None
        for b in batches:
            unit, p = np.full(b.num_rows, np.nan), np.zeros(b.num_rows)
            if forest is not None and b.num_rows:
                unit, p = forest.predict(np.column_stack([b.column(b.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in _FEATURES]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(unit, pa.float64(), mask=np.isnan(unit)), pa.array(p, pa.float64())], names=[*b.schema.names, "unit_model", "unit_confidence"])

    taken = F.col("unit_confidence") >= confident
    if settle == "rule":
        taken = taken & (F.col("unit_model") == 1.0)
    scored = asked.mapInArrow(score, schema).drop(*_FEATURES).withColumn("route", F.when(taken, "model").otherwise("review"))
    unit = F.when(F.col("route") == "model", F.col("unit_model"))
    scored = scored.withColumn("unit", unit if settle == "model" else F.lit(1.0))
    none = F.lit(None).cast("double")
    stated = x.where(F.col("unit_stated").isNotNull()).withColumns({"unit_model": none, "unit_confidence": none, "route": F.lit("stated"), "unit": F.col("unit_stated")})
    return stated.unionByName(scored)


def by_rule(x: DataFrame) -> DataFrame:
    """read_amounts() with unit and amount by the delivery's rule alone: a missing scale means single units. No model is trained or asked."""
    return x.withColumn("unit", F.coalesce("unit_stated", F.lit(1.0))).withColumn("amount", F.col("number") * F.col("unit") * F.col("rate"))


def convert(valuations: DataFrame, companies: DataFrame, fx: DataFrame, *, confident: float = CONFIDENT, settle: str = "rule") -> DataFrame:
    """Amounts in single units of the issuer's reporting currency.

    Every loadable amount comes out. Its amount is null where no rate is known
    and, with settle='model', where its unit is left for review. An empty table
    gives an empty result.
    """
    x = assign_units(read_amounts(valuations, companies, fx), confident=confident, settle=settle)
    return x.withColumn("amount", F.col("number") * F.col("unit") * F.col("rate")).select(
        "valuation_id", "run_id", "ticker", "snapshot_date", "provider", "number", "unit", "route", "unit_model", "unit_confidence",
        "currency", "reporting_currency", "rate", "amount",
    )


def agreeing_pairs(amounts: DataFrame, *, tolerance: float = TOLERANCE) -> DataFrame:
    """(valuation_a, valuation_b): amounts of different sources for one run, issuer and day that agree.

    Equal amounts of one source form one class, so repeated rows do not
    multiply the comparisons. Classes meet by the bin of their log amount and
    the next one, not within the whole group; members are joined to the pairs
    of classes at the end. Rows with a null run, issuer, day, source or amount
    have no partner.
    """
    stated = ["run_id", "ticker", "snapshot_date"]
    width = -float(np.log(1 - tolerance)) * (1 + 1e-9)
    # run and issuer as one 64-bit digest beside the day: the texts themselves would be costly in every shuffle below
    key = ["k1", "snapshot_date"]
    rows = amounts.where(" and ".join(f"{k} is not null" for k in [*stated, "provider", "amount"]) + " and amount > 0").select(
        "valuation_id", F.xxhash64("run_id", "ticker").alias("k1"), "snapshot_date", "provider", "amount")
    # read four times below: written once, where every executor can read it again
    rows = settled(rows)
    classes = rows.select(*key, "provider", "amount").distinct().withColumn("bin", F.floor(F.log("amount") / F.lit(width)))
    low = classes.select(*key, F.col("provider").alias("pa"), F.col("amount").alias("aa"), F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"))
    high = classes.select(*key, F.col("provider").alias("pb"), F.col("amount").alias("ab"), "bin")
    near = (F.col("ab") - F.col("aa") <= F.lit(tolerance) * F.col("ab")) & (F.col("pa") != F.col("pb"))
    ordered = (F.col("aa") < F.col("ab")) | ((F.col("aa") == F.col("ab")) & (F.col("pa") < F.col("pb")))
    pairs = low.join(high, [*key, "bin"]).where(near & ordered).select(*key, "pa", "aa", "pb", "ab")
    a = rows.select(*key, F.col("provider").alias("pa"), F.col("amount").alias("aa"), F.col("valuation_id").alias("ia"))
    b = rows.select(*key, F.col("provider").alias("pb"), F.col("amount").alias("ab"), F.col("valuation_id").alias("ib"))
    both = pairs.join(a, [*key, "pa", "aa"]).join(b, [*key, "pb", "ab"])
    return both.select(F.least("ia", "ib").alias("valuation_a"), F.greatest("ia", "ib").alias("valuation_b"))
