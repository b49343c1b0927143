"""The fitted feature plan: everything between a prepared table and the model's vector."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Mapping

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import PCAModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.functions.calendar import bizday, dateparts, timeparts
from tabforge.operators import encode, frame, rowstats, scaling, selection
from tabforge.operators.frame import quoted
from tabforge.operators.text import TextVectors
from tabforge.operators.unsupervised import Clusters, Components, assemble
from tabforge.operators.variables import latest_lag, transform_columns

# Column transforms a specification may name.
PARTS: dict[str, Callable[[Column], Mapping[str, Column]]] = {"dateparts": dateparts, "timeparts": timeparts, "bizday": bizday}



def part(name: str) -> Callable[[Column], Mapping[str, Column]]:
    """A transform of ``PARTS``, or the user's own, named ``module:function``: it takes a column and gives named columns."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function) if function else PARTS[name]


# Every specification key with its default.
DEFAULTS: dict = {
    "key": "key", "target": "target", "model_type": "classification", "features": "*", "drop": [], "factors": [],
    "encoder": "target", "rounding": 3, "sentinel": -1, "transforms": [], "counts": False, "log_transform": False,
    "pvalue_level": 0.05, "vectorize": False, "ngrams": 1, "scaling": "standard", "numpy": False, "scipy": False,
    "clustering": None, "pca": None, "interactions": None, "variance": None, "univariate": None,
    "date": None, "group": None, "level_vectors": False,
}


class FeaturePlan:
    """Fitted on training rows; ``transform`` gives (key, target if present, features) for any rows."""

    def __init__(self, spec: Mapping):
        self.spec = {**DEFAULTS, **spec}
        self.parts: dict = {}

    # -- stages ----------------------------------------------------------------

    def _prepare(self, df: DataFrame) -> DataFrame:
        s = self.spec
        for column, name in s["transforms"]:
            root = latest_lag(df, column)
            df = transform_columns(df, root, part(name))
        df = frame.select_features(df, s["features"], [c for c in self._carried(df)])
        df = frame.drop_by_root(df, s["drop"])
        booleans = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
        df = df.withColumns({c: F.col(f"`{c}`").cast("int") for c in booleans if c not in self._carried(df)})
        if s["counts"]:
            inputs = [c for c in df.columns if c not in self._carried(df)]
            df = frame.row_counts(df, inputs).drop("null_count")
        return df

    def _carried(self, df: DataFrame) -> list[str]:
        s = self.spec
        return [c for c in dict.fromkeys([s["key"], s["target"], s["date"], s["group"]]) if c and c in df.columns]

    def _inputs(self, df: DataFrame) -> list[T.StructField]:
        carried = set(self._carried(df))
        plain = (*frame.NUMERIC, T.StringType)
        return [f for f in df.schema.fields if f.name not in carried and isinstance(f.dataType, plain)]

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Fit on training rows and return them transformed (encoders may treat them specially)."""
        s, p = self.spec, self.parts
        df = self._prepare(df)
        inputs = self._inputs(df)
        factors = [f.name for f in inputs if f.name in s["factors"]]
        p["text"] = [f.name for f in inputs if isinstance(f.dataType, T.StringType) and f.name not in factors]
        numbers = [f.name for f in inputs if f.name not in factors and f.name not in p["text"]]
        df = df.select(*self._carried(df), *[quoted(f.name) for f in inputs])

        p["fill"] = scaling.fit_imputer(df.select(*[quoted(c) for c in numbers]), s["sentinel"]) if numbers else None
        if s["log_transform"]:
            filled = p["fill"].transform(df) if p["fill"] else df
            p["log"] = scaling.fit_log(filled, numbers, s["pvalue_level"])
        p["encoder"] = None
        encoded = df
        if factors:
            maker = encode.ENCODERS[s["encoder"]]
            supervised = issubclass(maker, encode._TargetFitter)
            extra = {"vectors": True} if s["level_vectors"] and issubclass(maker, encode._Expanding) else {}
            fitter = maker(factors, s["target"], rounding=s["rounding"]) if supervised else maker(factors, rounding=s["rounding"], **extra)
            p["encoder"] = fitter.fit(df)
            order = [quoted(c) for c in (s["date"], s["key"]) if c]
            encoded = fitter.fit_transform(df, order)
        p["vectors"], p["codes"] = {}, None
        if p["text"]:
            filled = scaling.fill_text(df, p["text"])
            if s["vectorize"]:
                p["vectors"] = {c: TextVectors.fit(filled, c, f"_tv{i}", s["ngrams"]) for i, c in enumerate(p["text"])}
            else:
                p["codes"] = encode.OrdinalEncoder(p["text"]).fit(filled)
        df = self._base(encoded)
        names = self._numeric(df)
        nonzero = frame.drop_zero_columns(df.select(*[quoted(c) for c in names]), names).columns
        p["base"] = nonzero
        p["scaler"] = None
        if s["scaling"]:
            p["scaler"] = (scaling.fit_standard if s["scaling"] == "standard" else scaling.fit_minmax)(df, nonzero)
            df = p["scaler"].transform(df)
        final = list(nonzero)
        p["stats"] = []
        for flag, fn, made in (
            ("numpy", rowstats.sums_and_spread, ["sum", "mean", "std", "var"]),
            ("scipy", rowstats.shape_statistics, list(rowstats.SHAPE_NAMES)),
        ):
            if s[flag]:
                df = fn(df, nonzero)
                fill = scaling.fit_median(df, made)
                fill.values = {c: v if v is not None else 0.0 for c, v in fill.values.items()}
                df = fill.transform(df)
                scaler = scaling.fit_standard(df, made)
                df = scaler.transform(df)
                p["stats"].append((flag, fill, scaler))
                final += made
        p["clusters"] = p["components"] = None
        if s["clustering"] or s["pca"]:
            df = self._standard(df, fit=True)
            if s["clustering"]:
                p["clusters"] = Clusters.fit(df, "_base", *s["clustering"])
                df = p["clusters"].transform(df)
                final += p["clusters"].names
            if s["pca"]:
                p["components"] = Components.fit(df, "_base", *s["pca"])
                df = p["components"].transform(df)
                final += p["components"].names
        score = "f_regression" if s["model_type"] == "regression" else "f_classif"
        p["interactions"] = None
        if s["interactions"]:
            percentage, degree = s["interactions"]
            p["interactions"] = selection.fit_interactions(df, final, s["target"], percentage, degree, score)
            df = p["interactions"].transform(df)
            final += p["interactions"].names
        if s["variance"] is not None:
            keep = set(selection.kept(selection.low_variance(df, final, s["variance"])))
            final = [c for c in final if c in keep]
        if s["univariate"]:
            keep = set(selection.kept(selection.support(selection.SCORERS[score](df, final, s["target"]), "percentile", s["univariate"])))
            final = [c for c in final if c in keep]
        p["final"] = final
        return self._finish(df)

    def _base(self, df: DataFrame) -> DataFrame:
        """Imputed numbers (with logs) and text columns of already encoded rows."""
        p = self.parts
        if p["fill"]:
            df = p["fill"].transform(df)
        if p.get("log"):
            df = p["log"].transform(df)
        if p["text"]:
            df = scaling.fill_text(df, p["text"])
            for c, v in p["vectors"].items():
                df = v.transform(df, c, self.spec["ngrams"]).drop(c)
            if p["codes"]:
                df = p["codes"].transform(df)
        return df

    def _standard(self, df: DataFrame, fit: bool = False) -> DataFrame:
        """``_base``: the base columns cleaned and standardised, the input of clusters and components; the columns themselves stay."""
        p = self.parts
        copies = {f"_z{i}": F.coalesce(scaling.finite(c), F.lit(0.0)) for i, c in enumerate(p["base"])}
        df = df.withColumns(copies)
        if fit:
            p["space"] = scaling.fit_standard(df, list(copies))
        return assemble(p["space"].transform(df), list(copies), "_base").drop(*copies)

    def _numeric(self, df: DataFrame) -> list[str]:
        carried = set(self._carried(df))
        return [c for c in frame.numeric_columns(df) if c not in carried]

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.parts
        df = self._prepare(df)
        if p["encoder"]:
            df = p["encoder"].transform(df)
        df = self._base(df)
        if p["scaler"]:
            df = p["scaler"].transform(df)
        for flag, fill, scaler in p["stats"]:
            fn = rowstats.sums_and_spread if flag == "numpy" else rowstats.shape_statistics
            df = scaler.transform(fill.transform(fn(df, p["base"])))
        if p["clusters"] or p["components"]:
            df = self._standard(df)
            for part in (p["clusters"], p["components"]):
                df = part.transform(df) if part else df
        if p["interactions"]:
            df = p["interactions"].transform(df)
        return self._finish(df)

    def _finish(self, df: DataFrame) -> DataFrame:
        """Carried columns, the final feature columns and their vector."""
        p = self.parts
        vectors = [f"_tv{i}" for i in range(len(p["vectors"]))] + (p["encoder"].names if isinstance(p["encoder"], encode.LevelVectors) else [])
        if vectors:
            plain = ["_plain"] if p["final"] else []
            df = assemble(df, p["final"], "_plain") if plain else df
            df = VectorAssembler(inputCols=[*plain, *vectors], outputCol="features").transform(df)
        else:
            df = assemble(df, p["final"], "features")
        return df.select(*self._carried(df), *[quoted(c) for c in p["final"]], "features")

    # -- persistence ------------------------------------------------------------

    def save(self, spark: SparkSession, path: str) -> None:
        p = self.parts
        state: dict = {"spec": self.spec, "text": p["text"], "base": p["base"], "final": p["final"]}
        state["fill"] = [p["fill"].values, sorted(p["fill"].floats)] if p["fill"] else None
        state["log"] = p["log"].columns if p.get("log") else None
        state["scaler"] = [p["scaler"].shift, p["scaler"].scale] if p["scaler"] else None
        state["space"] = [p["space"].shift, p["space"].scale] if p.get("space") else None
        state["stats"] = [[f, fill.values, sc.shift, sc.scale] for f, fill, sc in p["stats"]]
        state["vectors"] = list(p["vectors"])
        for c, v in p["vectors"].items():
            v.save(f"{path}/vectors_{p['text'].index(c)}")
        for name in ("encoder", "codes"):
            part = p[name]
            kind = None
            if isinstance(part, encode.HashingEncoder):
                kind = ["hashing", part.columns, part.buckets, part.rounding]
            elif part is not None:
                part.save(f"{path}/{name}")
                kind = ["levels" if isinstance(part, encode.LevelVectors) else "tables"]
            state[name] = kind
        if p["clusters"]:
            state["clusters"] = list(p["clusters"].models)
            for k, m in p["clusters"].models.items():
                m.write().overwrite().save(f"{path}/cluster_{k}")
        if p["components"]:
            state["components"] = [p["components"].sizes, p["components"].deviations]
            p["components"].model.write().overwrite().save(f"{path}/components")
        if p["interactions"]:
            i = p["interactions"]
            state["interactions"] = [[list(x) for x in i.products], i.scaler.shift if i.scaler else None, i.scaler.scale if i.scaler else None]
        spark.createDataFrame([(json.dumps(state),)], "state string").write.mode("overwrite").parquet(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeaturePlan:
        state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        plan = cls(state["spec"])
        p = plan.parts
        p.update(text=state["text"], base=state["base"], final=state["final"])
        p["fill"] = scaling.Fill(*state["fill"]) if state["fill"] else None
        p["log"] = scaling.LogTransform(state["log"]) if state["log"] is not None else None
        p["scaler"] = scaling.Linear(*state["scaler"]) if state["scaler"] else None
        p["space"] = scaling.Linear(*state["space"]) if state["space"] else None
        p["stats"] = [
            (f, scaling.Fill(values, list(values)), scaling.Linear(shift, scale)) for f, values, shift, scale in state["stats"]
        ]
        p["vectors"] = {c: TextVectors.load(f"{path}/vectors_{p['text'].index(c)}") for c in state["vectors"]}
        for name in ("encoder", "codes"):
            kind = state[name]
            p[name] = None
            if kind and kind[0] == "hashing":
                p[name] = encode.HashingEncoder(kind[1], kind[2], kind[3])
            elif kind and kind[0] == "levels":
                p[name] = encode.LevelVectors.load(spark, f"{path}/{name}")
            elif kind:
                p[name] = encode.EncoderModel.load(spark, f"{path}/{name}")
        ks = state.get("clusters")
        p["clusters"] = Clusters({k: KMeansModel.load(f"{path}/cluster_{k}") for k in ks}) if ks else None
        comp = state.get("components")
        p["components"] = Components(PCAModel.load(f"{path}/components"), *comp) if comp else None
        inter = state.get("interactions")
        p["interactions"] = None
        if inter:
            scaler = scaling.Linear(inter[1], inter[2]) if inter[1] is not None else None
            p["interactions"] = selection.Interactions(inter[0], scaler)
        return plan
