"""The query functions of one graph as a client calls them: ids in, plain values out, every call logged."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .agent import ReadLog
from .functions.ids import parse_item
from .operators import build, nav, record, search
from .operators.nav import Policy
from .schema import LANGUAGES


class GraphClient:
    """Nodes (qid, label_en, ...), edges (src, prop, dst) and what a record holds, as frames; a call that finds nothing for its anchor raises KeyError.

    claims: subject, prop, value, rank, place; texts: entity, language, description, doc_id; sources: subject, prop, value, source_prop, source;
    records: qid and a column per field and language, as ``build.pivot_texts`` makes them (else the nodes' own columns serve); property_labels: pid, language, label.
    The first call that opens an entity's record costs a read, later ones of that record are free; descriptions out of ``texts`` are no part of a record and cost a read each.
    """

    def __init__(
        self, nodes: DataFrame, edges: DataFrame, claims: DataFrame | None = None, texts: DataFrame | None = None, policy: Policy | None = None, budget: int | None = None,
        sources: DataFrame | None = None, records: DataFrame | None = None, property_labels: DataFrame | None = None,
    ):
        self.nodes, self.policy, self.log = nodes, policy or Policy(), ReadLog(budget)
        self.degrees = build.degrees(edges)
        self.banned = self.policy.banned(edges, self.degrees)
        self.edges_frame, self.stored = self.policy.allowed(edges, self.degrees), edges
        self.claims_frame, self.texts, self.sources, self.property_labels = claims, texts, sources, property_labels
        self.records = nodes if records is None else records
        self._opened: dict[int, dict[str, Any]] = {}

    def _record(self, value: str | int) -> tuple[int, dict[str, Any], bool]:
        """The id, its record, and whether the record was open before; the read budget bounds how many are held."""
        q = parse_item(value)
        free = q in self._opened
        if not free:
            row = self.records.where(F.col("qid") == q).first()
            if row is None:
                raise KeyError(value)
            self._opened[q] = row.asDict(recursive=True)
        return q, self._opened[q], free

    def _property_names(self) -> DataFrame | None:
        """prop and its English label."""
        if self.property_labels is None:
            return None
        return self.property_labels.where("language = 'en'").groupBy(F.col("pid").alias("prop")).agg(F.min("label").alias("property_label"))

    def _labelled(self, rows: DataFrame) -> DataFrame:
        names = self._property_names()
        return rows.withColumn("property_label", F.lit(None).cast("string")) if names is None else rows.join(names, "prop", "left")

    def _anchor(self, value: str | int) -> tuple[int, DataFrame]:
        q = parse_item(value)
        if self.nodes.where(F.col("qid") == q).isEmpty() or not self.banned.where(F.col("qid") == q).isEmpty():
            raise KeyError(value)
        return q, self.nodes.where(F.col("qid") == q).select(F.col("qid").alias("anchor"))

    def has(self, value: str) -> bool:
        try:
            q = parse_item(value)
        except KeyError:
            self.log.add("has", [value], [])
            return False
        found = not self.nodes.where(F.col("qid") == q).isEmpty()
        self.log.add("has", [value], [f"Q{q}"] if found else [])
        return found

    def name(self, value: str) -> str | None:
        row = self.nodes.where(F.col("qid") == parse_item(value)).select("label_en").first()
        self.log.add("name", [value], [value] if row else [])
        return row[0] if row else None

    def degree(self, value: str) -> tuple[int, int]:
        q, _ = self._anchor(value)
        row = self.degrees.where(F.col("qid") == q).first()
        self.log.add("degree", [value], [value])
        return (row["deg_out"], row["deg_in"]) if row else (0, 0)

    def count_edges(self, value: str, direction: str = "both", pid: int | None = None) -> dict[str, int]:
        _, anchor = self._anchor(value)
        row = nav.count_edges(self.edges_frame, anchor, direction, pid).first()
        self.log.add("count_edges", [value, direction, pid], [value])
        return {k: row[k] for k in ("out", "in_", "total")}

    def edges(self, value: str, direction: str = "both", pid: int | None = None, limit: int = 0, offset: int = 0) -> dict[str, Any]:
        _, anchor = self._anchor(value)
        rows = nav.edges_page(self.edges_frame, self.nodes, anchor, direction, pid, limit, offset, self.policy.page).orderBy("direction", "place").collect()
        out: dict[str, Any] = {"id": value, "out": [], "in_": [], "truncated": {"out": False, "in": False}}
        for r in rows:
            out["out" if r["direction"] == "out" else "in_"].append((f"P{r['prop']}", f"Q{r['other']}", r["label"]))
            out["truncated"][r["direction"]] |= r["truncated"]
        self.log.add("edges", [value, direction, None if pid is None else str(pid)], [value, *[f"Q{r['other']}" for r in rows]])
        return out

    def neighbors(self, value: str, pid: int | None = None, limit: int = 0) -> list[tuple]:
        return self.edges(value, "out", pid, limit)["out"]

    def backlinks(self, value: str, pid: int | None = None, limit: int = 0) -> list[tuple]:
        return self.edges(value, "in", pid, limit)["in_"]

    def claims(self, value: str, pid: int | None = None, all_ranks: bool = False) -> list[dict]:
        q, _, free = self._record(value)
        rows = record.ranked_claims(self.claims_frame.where(F.col("subject") == q))
        rows = rows if all_ranks else record.best_rank(rows)
        rows = rows.where(F.col("prop") == pid) if pid is not None else rows
        named = rows.join(self.nodes.select(F.col("qid").alias("value"), F.col("label_en").alias("value_label")), "value", "left")
        found = self._labelled(named).orderBy("prop", "value").collect()
        self.log.add("claims", [value, pid], [value, *[f"Q{r['value']}" for r in found]], free)
        return [{"property": f"P{r['prop']}", "property_label": r["property_label"], "value": f"Q{r['value']}", "value_label": r["value_label"], "rank": r["rank"]} for r in found]

    def references(self, value: str, pid: int | None = None) -> list[dict]:
        q, _, free = self._record(value)
        rows = self.sources.where(F.col("subject") == q)
        rows = rows.where(F.col("prop") == pid) if pid is not None else rows
        found = self._labelled(record.references(rows)).orderBy("prop", "value").collect()
        self.log.add("references", [value, pid], [value], free)
        return [{"property": f"P{r['prop']}", "property_label": r["property_label"], "value": f"Q{r['value']}", "sources": [{"property": x["source_prop"], "value": x["source"]} for x in r["sources"]]} for r in found]

    def describe(self, value: str, languages: tuple[str, ...] | None = None) -> dict[str, Any]:
        q, held, free = self._record(value)
        wanted, fields = list(languages or LANGUAGES), ("label", "description", "aliases", "sitelink")
        entries = {lang: {f: held.get(f"{f}_{lang}") for f in fields} for lang in wanted}
        self.log.add("describe", [value, wanted], [value], free)
        return {"id": f"Q{q}", "instance_of": held.get("class_id"), "languages": {lang: e for lang, e in entries.items() if any(e.values())}}

    def entity(self, value: str) -> dict[str, Any]:
        q, held, free = self._record(value)
        props = [] if self.claims_frame is None else [f"P{r['prop']}" for r in self.claims_frame.where(F.col("subject") == q).select("prop").distinct().orderBy("prop").collect()]
        self.log.add("entity", [value], [value], free)
        return {"id": f"Q{q}", "label": held.get("label_en"), "description": held.get("description_en"), "instance_of": held.get("class_id"), "properties": props, "n_properties": len(props)}

    def _text(self, field: str, value: str, language: str) -> str | None:
        _, held, free = self._record(value)
        self.log.add(field, [value, language], [value], free)
        return held.get(f"{field}_{language}")

    def _texts(self, field: str, value: str) -> dict[str, str]:
        _, held, free = self._record(value)
        self.log.add(f"{field}s", [value], [value], free)
        return {lang: held[f"{field}_{lang}"] for lang in LANGUAGES if held.get(f"{field}_{lang}")}

    def label(self, value: str, language: str = "en") -> str | None:
        """One language, no fallback."""
        return self._text("label", value, language)

    def labels(self, value: str) -> dict[str, str]:
        return self._texts("label", value)

    def description(self, value: str, language: str = "en") -> str | None:
        """One language, no fallback."""
        return self._text("description", value, language)

    def descriptions(self, value: str) -> dict[str, str]:
        if self.texts is None:
            return self._texts("description", value)
        rows = self.texts.where(F.col("entity") == value).where("description is not null").groupBy("language").agg(F.min_by("description", "doc_id").alias("d")).collect()
        self.log.add("descriptions", [value], [value] if rows else [])
        return {r["language"]: r["d"] for r in rows}

    def search_property(self, text: str, limit: int = 10) -> tuple[int, list[dict]]:
        """How many properties match, and the best of them; an empty text finds nothing and is free."""
        key = text.strip().lower()
        if not key:
            return 0, []
        rows = search.search_property(self.property_labels, key, limit).orderBy("tier", "pid").collect()
        self.log.add("search_property", [key, limit], [f"P{r['pid']}" for r in rows])
        return (rows[0]["total"] if rows else 0), [{"pid": f"P{r['pid']}", "label": r["label"], "lang": r["language"]} for r in rows]

    def search_entity(self, postings: DataFrame, notable: DataFrame, text: str, lengths: DataFrame, limit: int = 10) -> list[dict]:
        spark = postings.sparkSession
        queries = spark.createDataFrame([(text, search.query_words(text, spark))], "query string, words array<string>")
        n = self.nodes.count()
        rows = search.search_entity(postings, notable, queries, n, lengths, limit).orderBy("place").collect()
        self.log.add("search_entity", [text, limit], [f"Q{r['qid']}" for r in rows])
        return [r.asDict() for r in rows]

    def stats(self) -> dict[str, int]:
        return nav.graph_stats(self.nodes, self.stored).first().asDict()

    def reads_left(self) -> int | None:
        return self.log.left()
