"""The engine: a graph of stages, each a lazy table that is written once and read by later ones."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.operators import clean, enrich, features, graph, metrics, ml, plots, stats
from tessera.plans import report
from tessera.sources import sinks

log = logging.getLogger(__name__)


@dataclass
class Inputs:
    """Long expression of both cohorts, known genes, and optionally sample metadata, query genes and gene sets."""

    expr: DataFrame
    labels: DataFrame
    case_metadata: DataFrame | None = None
    control_metadata: DataFrame | None = None
    query: DataFrame | None = None
    gene_sets: DataFrame | None = None


@dataclass
class Outcome:
    seconds: dict[str, float] = field(default_factory=dict)
    failed: str | None = None
    error: str | None = None
    sections: dict[str, str] = field(default_factory=dict)


class Engine:
    """run(from_stage, to_stage) computes stages in order and stops at the first that fails; table(name) reads one.

    Tables lie under config.output and a key of the configuration, so a changed threshold never meets an old table.
    """

    def __init__(self, spark: SparkSession, inputs: Inputs, config: EngineConfig = EngineConfig(), chosen: dict[str, object] | None = None):
        self.spark, self.inputs, self.config = spark, inputs, config
        self.chosen = chosen or ml.models(config.seed)
        self.root = f"{config.output}/{config.key()}"
        self.fitted: object | None = None
        self.stages: list[tuple[str, Callable[[], dict[str, DataFrame] | None]]] = [
            ("load", self._load), ("preprocess", self._preprocess), ("harmonise", self._harmonise), ("differential", self._differential),
            ("expression_features", self._expression_features), ("network", self._network), ("network_features", self._network_features),
            ("integrate", self._integrate), ("labels", self._labels), ("split", self._split), ("train", self._train), ("evaluate", self._evaluate),
            ("importance", self._importance), ("rank", self._rank), ("annotate", self._annotate), ("export", self._export), ("enrich", self._enrich),
            ("report", self._report),
        ]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path(name)}.parquet")

    def _exists(self, name: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}.parquet/_SUCCESS")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def run(self, from_stage: str | None = None, to_stage: str | None = None) -> Outcome:
        names = [n for n, _ in self.stages]
        first = names.index(from_stage) if from_stage else 0
        last = names.index(to_stage) if to_stage else len(names) - 1
        out = Outcome()
        for name, stage in self.stages[first : last + 1]:
            began = time.monotonic()
            try:
                for table, df in (stage() or {}).items():
                    if not (self.config.use_cache and self._exists(table)):
                        sinks.write_table(df, self.path(table), self.config.formats)
            except Exception as e:
                log.exception("stage %s failed", name)
                out.failed, out.error = name, str(e)
                break
            finally:
                out.seconds[name] = round(time.monotonic() - began, 3)
                log.info("stage %s: %.1f s", name, out.seconds[name])
        out.sections = getattr(self, "_sections", {})
        return out

    def _load(self):
        return {"expr_raw": self.inputs.expr, "label_genes": self.inputs.labels}

    def _preprocess(self):
        e, c = self.table("expr_raw"), self.config
        for cohort, meta in (("tumor", self.inputs.case_metadata), ("normal", self.inputs.control_metadata)):
            if meta is not None:
                kept = clean.match_samples(e.filter(F.col("cohort") == cohort), meta, "sample_id")
                e = kept.unionByName(e.filter(F.col("cohort") != cohort))
        clean.require_samples(e, {"tumor": c.min_samples_case, "normal": c.min_samples_control})
        if "_row" in e.columns:
            e = clean.keep_highest_mean(e).drop("_row")
        logged = e.withColumn("value", clean.log2p1(clean.positive_only("value")))
        expressed = clean.keep(logged, clean.expressed_genes(logged, c.min_value, c.min_fraction))
        final = clean.keep(expressed, clean.variable_genes(expressed, c.variance_quantile))
        return {"expr_clean": final, "qc_summary": clean.stage_counts({"raw": e, "expressed": expressed, "variable": final})}

    def _harmonise(self):
        e = clean.harmonise(self.table("expr_clean"))
        return {"expr": e, "retention_report": clean.retention(self.table("label_genes"), {"clean": self.table("expr_clean").select(clean.key("gene").alias("gene")), "harmonised": e.select("gene")})}

    def _differential(self):
        return {"de_results": stats.differential(self.table("expr"), self.config.fdr, self.config.log2fc)}

    def _expression_features(self):
        return {"expression_features": stats.expression_features(self.table("expr"), self.table("de_results"))}

    def _network(self):
        genes = graph.vectors(self.table("expr").filter("cohort = 'tumor'"))
        edges = graph.correlation_edges(genes, self.config.cutoff, nan_policy=self.config.nan_policy)
        return {"edges": graph.weighted(edges), "nodes": genes.select("gene")}

    def _network_features(self):
        return {"network_features": graph.network_features(self.table("edges"), self.table("nodes"))}

    def _integrate(self):
        raw = features.drop_constant(features.integrate(self.table("expression_features"), self.table("network_features")))
        columns = features.feature_columns(raw)
        raw = stats.impute_median(raw.withColumns({c: F.col(c).cast("double") for c in columns}), columns)
        return {"features": raw, "features_scaled": features.scale(raw, features.robust_parameters(raw, columns), columns), "correlated_pairs": features.correlated_pairs(raw)}

    def _labels(self):
        labels = features.label_genes(self.table("features").select("gene"), self.table("label_genes"))
        return {"gene_labels": labels, "gene_annotation": features.annotate(labels, self.table("de_results")), "class_balance": plots.class_balance(labels)}

    def _split(self):
        df = self.table("features").join(self.table("gene_labels").select("gene", "label"), "gene")
        cut = features.split(df, self.config.test_fraction, self.config.seed)
        train = features.folds(cut.filter(~F.col("is_test")).drop("is_test"), self.config.folds, self.config.seed)
        return {"train": train, "holdout": cut.filter("is_test").drop("is_test"), "cv_folds": train.select("gene", "cv_fold", "label")}

    def _columns(self) -> list[str]:
        return features.feature_columns(self.table("features"))

    def _train(self):
        folds = ml.cross_validate(self.table("train"), self._columns(), self.chosen, self.config.undersample, self.config.smote, self.config.seed)
        return {"cv_results": ml.cv_table(folds)}

    def _best(self):
        """The chosen model, fitted once on all training rows."""
        if self.fitted is None:
            name = ml.best_model(self.table("cv_results"), self.config.primary_metric, list(self.chosen))
            self.fitted = (name, self.chosen[name].fit(self.table("train").drop("cv_fold"), self._columns()))
            saved = getattr(self.fitted[1], "fitted", None)
            if hasattr(saved, "write"):
                saved.write().overwrite().save(self.path("best_model"))
        return self.fitted

    def _evaluate(self):
        c, rows = self.config, None
        for name, model in self.chosen.items():
            fitted = self._best()[1] if name == self._best()[0] else model.fit(self.table("train").drop("cv_fold"), self._columns())
            one = metrics.evaluate(fitted.score(self.table("holdout")), name, c.threshold_strategy, target_recall=c.target_recall, target_precision=c.target_precision, top_k=c.threshold_top_k)
            rows = one if rows is None else rows.union(one)
        best = self._best()[1].score(self.table("holdout"))
        return {"model_metrics": rows.orderBy(F.desc("auprc")), "roc": metrics.roc_points(best), "pr": metrics.pr_points(best), "classification_report": metrics.classification_report(best)}

    def _importance(self):
        name, model = self._best()
        methods = {name: model.importance()} if hasattr(model, "importance") else {}
        drops = ml.permutation_importance(model, self.table("holdout"), self._columns(), self.config.importance_repeats, self.config.seed)
        methods["permutation"] = {r["feature"]: r["importance"] or 0.0 for r in drops.collect()}  # a row per feature
        found = ml.importance_table(self.spark, methods)
        return {"feature_importance": found, "group_importance": plots.group_importance(found)}

    def _rank(self):
        name, model = self._best()
        if self.config.legacy_scaler and getattr(model, "parameters", None) is not None:
            model.parameters = features.robust_parameters(self.table("features"), self._columns())
        t = self.table("model_metrics").filter(F.col("model_name") == name).first()["optimal_threshold"]
        annotation = self.table("gene_annotation").drop("cohens_d", "pu_status", "significant")
        ranking = metrics.rank_genes(model.score(self.table("features")), annotation, t, self.config.prob_threshold)
        if self.inputs.query is not None:
            asked = self.inputs.query.select("gene", F.lit(True).alias("_q")).distinct()
            ranking = ranking.join(asked, "gene", "left").withColumn("is_query_gene", F.coalesce("_q", F.lit(False))).drop("_q")
            ranking = ranking.withColumn("novel_candidate", F.col("novel_candidate") & F.col("is_query_gene") & F.col("is_de_significant"))
        return {"gene_rankings": ranking, "ranking_metrics": metrics.ranking_metrics(ranking), "novel_candidates": ranking.filter("novel_candidate"), "enrichment_curve": metrics.enrichment_curve(ranking), "score_histogram": metrics.histogram(ranking, "predicted_prob")}

    def _annotate(self):
        ranking = self.table("gene_rankings")
        nodes = graph.annotated_nodes(self.table("nodes"), ranking, self.table("network_features"))
        return {
            "annotated_nodes": nodes, "annotated_edges": graph.annotated_edges(self.table("edges"), ranking, self.config.prob_threshold), "network_stats": graph.statistics(self.table("edges"), self.table("nodes")), "hubs": graph.hubs(self.table("edges")), "run_summary": plots.run_summary(ranking, self.table("edges")),
            "degree_against_rank": plots.degree_against_rank(ranking, self.table("network_features")), "ranked_differential": plots.ranked_differential(self.table("de_results"), ranking),
            "first_significant": plots.first_significant(self.table("de_results")), "change_histogram": plots.change_histogram(self.table("de_results")),
        }

    def _export(self):
        nodes, edges = self.table("annotated_nodes"), self.table("annotated_edges")
        keys = nodes.select("gene", "label", "novel_candidate", "predicted_prob", "rank")
        subsets = {
            "top100": keys.orderBy("rank", "gene").limit(100), "known": keys.filter("label = 1"), "novel": keys.filter("novel_candidate"), "candidates": keys.filter(F.col("predicted_prob") >= self.config.prob_threshold),
        }
        for name, genes in subsets.items():
            sinks.export_graph(nodes.join(genes.select("gene"), "gene", "left_semi"), graph.induced(edges, genes), self.path(f"network/{name}"))

    def _enrich(self):
        if self.inputs.gene_sets is None:
            return None
        lists = enrich.high_confidence(self.table("gene_rankings"), self.config.high_confidence)
        results = {k: enrich.enrich(g, self.inputs.gene_sets, self.table("features").select("gene"), self.config.min_overlap) for k, g in lists.items()}
        if self.config.pathway_names:
            results = {k: r.filter(enrich.name_matches("pathway", list(self.config.pathway_names))) for k, r in results.items()}
        return {"pathways": results["all"], "pathway_summary": enrich.summarise(results), "top_pathways": plots.top_pathways(results["all"], fdr=self.config.fdr)}

    def _report(self):
        self._sections = report.write(self)
        return {"pipeline_summary": report.summary_table(self)}
