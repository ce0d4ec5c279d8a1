"""Documents to graph: typed rows, resolution joins, triples and provenance.

Each file is parsed and checked on its own, as a row-local step in Python, into records of
one wide type; rejects are records too. All that needs more than one file is a join or an
aggregate: names resolve by slug, duplicate keys are counts, sequence members are ranked by
a window. Faults of research files are fatal, others skip their file or item.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions.text import gyear, make_slug, slug
from ..sources.frontmatter import HeadError, parse_frontmatter
from ..sources.project import Config
from ..terms import LABEL, TYPE, XSD, empty_graph, graph_union, iri, literal, triple_rows
from .store import Store


class IngestError(ValueError):
    """A fault that stops a build: code is slug_collision or research."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


RECORD = """concept string, relpath string, pos int, name string, slug string, reject string, fatal string,
 unknown array<string>, soft array<string>, lines map<string,int>, born int, died int, features array<string>, roles array<string>,
 setting string, begin int, end int, participants array<string>, relations array<struct<rel:string,name:string>>,
 functions array<string>, sequence string, ord int, facets map<string,string>, id string, claim string, asserted_by string,
 bears_on string, sources array<string>, open boolean, promotes string, constrains string"""
FIELDS = [part.split()[0] for part in RECORD.replace("\n", " ").replace("rel:string,name:string", "x").replace("string,int", "x").replace("string,string", "x").split(",")]

# Allowed keys by concept.
KEYS = {
    "character": {"name", "born", "died", "features", "narrative_roles"},
    "setting": {"name"},
    "object": {"name"},
    "location": {"name", "setting"},
    "event": {"name", "participants", "begin", "end", "date", *V.RELATIONS},
    "relationship": {"name", "participants"},
    "narrative-unit": {"name", "functions", "roles", "sequence", "order"},
}
SOURCE_FACETS = ("name", "reference", "author", "original_language", "type", "reliability", "reliability_justification", "access_date", "original_quote")


class Reject(ValueError):
    pass


def _name(meta: dict) -> str:
    name = meta.get("name")
    if not isinstance(name, str) or not name.strip():
        raise Reject("missing required `name`")
    if make_slug(name) is None:
        raise Reject(f"`name` {name!r} has no letters or digits to build an identifier from")
    return name


def _year(meta: dict, key: str) -> int | None:
    value = meta.get(key)
    if value is None:
        return None
    if not isinstance(value, int) or isinstance(value, bool):
        raise Reject(f"`{key}` must be an integer year")
    return value


def _strings(meta: dict, key: str) -> list[str]:
    value = meta.get(key)
    if value is None:
        return []
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise Reject(f"`{key}` must be a list of strings")
    return value


def _sluggable(names: list[str]) -> list[str]:
    for name in names:
        if make_slug(name) is None:
            raise Reject(f"{name!r} has no letters or digits to build an identifier from")
    return names


def _distinct(names: list[str]) -> list[str]:
    """The first spelling of each slug; names without one are dropped."""
    out: dict[str, str] = {}
    for name in names:
        if s := make_slug(name):
            out.setdefault(s, name)
    return list(out.values())


def _record(concept: str, relpath: str, pos: int, meta: dict, lines: dict) -> dict:
    """One checked record; a rejected one keeps only its place and reason."""
    out = {"concept": concept, "relpath": relpath, "pos": pos, "lines": lines, "soft": []}
    try:
        out |= {"name": (name := _name(meta)), "slug": make_slug(name)}
        if concept == "character":
            out |= {"born": _year(meta, "born"), "died": _year(meta, "died"), "features": _distinct(_sluggable(_strings(meta, "features")))}
            out["roles"] = _distinct(_sluggable(_strings(meta, "narrative_roles")))
        elif concept == "location":
            if meta.get("setting") is not None and not isinstance(meta["setting"], str):
                raise Reject("`setting` must be a string")
            out["setting"] = (meta.get("setting") or "").strip() or None
        elif concept in ("event", "relationship"):
            out["participants"] = _strings(meta, "participants")
            if concept == "event":
                begin, end, date = (_year(meta, k) for k in ("begin", "end", "date"))
                if date is not None and (begin is not None or end is not None):
                    out["soft"] = ["date"]
                elif date is not None:
                    begin = end = date
                out |= {"begin": begin, "end": end}
                out["relations"] = [{"rel": r, "name": n} for r in V.RELATIONS for n in _sluggable(_strings(meta, r))]
        elif concept == "narrative-unit":
            out |= {"functions": _distinct(_strings(meta, "functions")), "roles": _distinct(_strings(meta, "roles"))}
            sequence, order = meta.get("sequence"), meta.get("order")
            if sequence is not None and not isinstance(sequence, str):
                raise Reject("`sequence` must be a string")
            sequence = (sequence or "").strip() or None
            if sequence and make_slug(sequence) is None:
                raise Reject(f"`sequence` {sequence!r} has no letters or digits to build an identifier from")
            if order is not None and (not isinstance(order, int) or isinstance(order, bool)):
                raise Reject("`order` must be an integer")
            out |= {"sequence": sequence, "ord": order if sequence else None}
            if order is not None and not sequence:
                out["soft"] = ["order"]
        out["unknown"] = sorted(str(k) for k in meta if k not in KEYS[concept])
    except Reject as e:
        return {"concept": concept, "relpath": relpath, "pos": pos, "reject": str(e)}
    return out


def _source(relpath: str, pos: int, raw: object, language: str) -> dict:
    out: dict = {"concept": "source", "relpath": relpath, "pos": pos}
    if not isinstance(raw, dict):
        return out | {"fatal": f"each `sources` item must be a mapping in {relpath}"}
    who = f"source '{raw['name']}'" if isinstance(raw.get("name"), str) and raw["name"].strip() else f"source #{pos + 1}"
    facets = {}
    for key in (*SOURCE_FACETS, "translation"):
        value = raw.get(key)
        if key == "access_date" and value is not None and (not isinstance(value, datetime.date)):
            return out | {"fatal": f"{who}: `access_date` must be a date in {relpath}"}
        if key != "translation" and (value is None or (isinstance(value, str) and not value.strip())):
            return out | {"fatal": f"{who}: source is missing required `{key}` in {relpath}"}
        if value is not None and key != "access_date" and not isinstance(value, str):
            return out | {"fatal": f"{who}: `{key}` must be a string in {relpath}"}
        if value is not None:
            facets[key] = str(value)
    if make_slug(facets["name"]) is None:
        return out | {"fatal": f"{who}: source `name` is empty or unsluggable in {relpath}"}
    if facets["type"] not in V.SOURCE_TYPES:
        return out | {"fatal": f"{who}: unknown source type {facets['type']!r} in {relpath}; one of: {', '.join(V.SOURCE_TYPES)}"}
    if facets["reliability"] not in V.RELIABILITY:
        return out | {"fatal": f"{who}: unknown reliability {facets['reliability']!r} in {relpath}; one of: {', '.join(reversed(V.RELIABILITY))}"}
    if facets["original_language"] == language:
        facets.pop("translation", None)  # only a foreign source carries one
    elif not facets.get("translation", "").strip():
        return out | {"fatal": f"{who}: needs a translation (language {facets['original_language']!r} ≠ book {language!r}) in {relpath}"}
    return out | {"name": facets["name"], "slug": make_slug(facets["name"]), "facets": facets}


def _finding(relpath: str, pos: int, raw: object, index: bool) -> dict:
    out: dict = {"concept": "finding", "relpath": relpath, "pos": pos}
    if not isinstance(raw, dict):
        return out | {"fatal": f"each finding must be a mapping in {relpath}"}
    id_ = raw.get("id")
    if not isinstance(id_, str) or not id_.strip():
        return out | {"fatal": f"a finding is missing its `id` in {relpath}"}
    claim = raw.get("claim")
    claim = claim if isinstance(claim, str) and claim.strip() else None
    sources, open_ = raw.get("sources"), bool(index or raw.get("open") is True)
    if sources is not None and not isinstance(sources, list):
        return out | {"fatal": f"`sources` must be a list of source names in {relpath}"}
    if not open_ and (claim is None or not sources):
        return out | {"fatal": f"finding {id_!r} needs a `claim` and at least one `source` in {relpath}"}
    text = lambda key: str(raw[key]) if raw.get(key) is not None and str(raw[key]).strip() else None
    return out | {"id": id_, "claim": claim, "asserted_by": text("asserted_by") or "author", "bears_on": text("bears_on"), "sources": [str(s) for s in sources or []], "open": open_}


def _anchor(relpath: str, pos: int, raw: object) -> dict:
    out: dict = {"concept": "anchor", "relpath": relpath, "pos": pos}
    if not isinstance(raw, dict):
        return out | {"fatal": f"each anchor must be a mapping in {relpath}"}
    if "constrains" not in raw:
        return out | {"fatal": f"anchor is missing required `constrains` in {relpath}"}
    years = {}
    for key in ("begin", "end", "date"):
        value = raw.get(key)
        if value is not None and (not isinstance(value, int) or isinstance(value, bool)):
            return out | {"fatal": f"anchor `{key}` must be an integer year in {relpath}"}
        years[key] = value
    if years["date"] is not None:
        if years["begin"] is not None or years["end"] is not None:
            return out | {"fatal": f"anchor `date` is mutually exclusive with `begin`/`end` in {relpath}"}
        years["begin"] = years["end"] = years["date"]
    target = raw["constrains"]
    return out | {"promotes": str(raw.get("promotes")), "constrains": str(target) if target is not None and str(target).strip() else None, "begin": years["begin"], "end": years["end"]}


CONTAINERS = {"timeline": ("events", "event"), "relationships": ("relationships", "relationship")}


def parse_file(relpath: str, role: str, content: bytes, language: str) -> list[dict]:
    """The records of one file."""
    research = role in ("sources", "topic", "index")
    concept = {"unit": "narrative-unit", **{r: c for r, (_, c) in CONTAINERS.items()}}.get(role, role)
    try:
        meta, _, lines = parse_frontmatter(bytes(content).decode("utf-8-sig"))
    except UnicodeDecodeError as e:
        why = f"cannot read {relpath}: {e}" if research else f"unreadable file: {e}"
        return [{"concept": concept, "relpath": relpath, "pos": 0, "fatal" if research else "reject": why}]
    except HeadError as e:
        why = f"malformed YAML front-matter in {relpath}: {e}" if research else f"malformed YAML frontmatter: {e}"
        return [{"concept": concept, "relpath": relpath, "pos": 0, "fatal" if research else "reject": why}]
    if role in CONTAINERS:
        container, concept = CONTAINERS[role]
        items = meta.get(container)
        if items is None:
            return []
        if not isinstance(items, list):
            return [{"concept": concept, "relpath": relpath, "pos": 0, "reject": f"`{container}` must be a list"}]
        out = []
        for pos, item in enumerate(items):
            if not isinstance(item, dict):
                out.append({"concept": concept, "relpath": relpath, "pos": pos, "reject": f"each `{container}` item must be a mapping"})
            elif not isinstance(item.get("name"), str) or not item["name"].strip():
                out.append({"concept": concept, "relpath": relpath, "pos": pos, "reject": f"a `{container}` item is missing `name`"})
            else:
                out.append(_record(concept, relpath, pos, item, lines))
        return out
    if research:
        def items_of(key: str) -> list:
            value = meta.get(key)
            return value if isinstance(value, list) else [] if value is None else [None]

        if role == "sources":
            return [_source(relpath, i, raw, language) for i, raw in enumerate(items_of("sources"))]
        if role == "index":
            return [_finding(relpath, i, raw, True) for i, raw in enumerate(items_of("open_questions"))]
        return [_finding(relpath, i, raw, False) for i, raw in enumerate(items_of("findings"))] + [_anchor(relpath, i, raw) for i, raw in enumerate(items_of("anchors"))]
    return [_record(concept, relpath, 0, meta, lines)]


ROLES = ["character", "setting", "location", "object", "timeline", "relationships", "unit", "sources", "topic", "index"]


def records(files: DataFrame, language: str) -> DataFrame:
    """All records of the files that carry data. Files are dealt over the tasks: a small table may hold very many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for f in batch.itertuples() for r in parse_file(f.relpath, f.role, f.content, language)]
            out = pd.DataFrame([[r.get(k) for k in FIELDS] for r in rows], columns=FIELDS)
            for k in ("pos", "born", "died", "begin", "end", "ord"):
                out[k] = out[k].astype("Int32")
            yield out

    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.where(F.col("role").isin(ROLES)).repartition(tasks, "relpath").mapInPandas(run, RECORD)


@dataclass
class Build:
    """A build: records, the graph, and the channels of what was set aside."""

    records: DataFrame
    graph: DataFrame
    skipped: DataFrame  # relpath, reason
    unknown_keys: DataFrame  # relpath, key
    unresolved: DataFrame  # relpath, field, entity, name
    untyped: DataFrame  # vocabulary, name
    warnings: DataFrame  # relpath, field, name
    findings: DataFrame  # uri, id, relpath
    anchors: DataFrame  # uri, promotes_id, constrains_name, relpath
    config: Config
    sequences: DataFrame | None = None  # uri, slug, name, relpath
    files: int = 0  # those that carry data
    counts: dict[str, int] = field(default_factory=dict)  # good records of each concept and the triples, seen while they were written

    def report(self) -> dict:
        """Counters and channels; exit code 4 where a file was skipped, else 0."""
        skipped = [tuple(r) for r in self.skipped.orderBy("relpath", "reason").collect()]
        rows = lambda df: [tuple(r) for r in df.orderBy(*df.columns).collect()]
        return {
            "files": self.files,
            "entities": sum(self.counts[c] for c in KEYS),
            "sources": self.counts["source"],
            "findings": self.counts["finding"],
            "anchors": self.counts["anchor"],
            "triples": self.counts["triples"],
            "skipped": skipped,
            "unknown_keys": rows(self.unknown_keys),
            "unresolved_references": rows(self.unresolved),
            "untyped_terms": rows(self.untyped),
            "warnings": rows(self.warnings),
            "exit_code": 4 if skipped else 0,
        }


def vocabulary_index(graph: DataFrame) -> DataFrame:
    """(slug, term) of every label of the types in a vocabulary graph; a slug with two terms is an error."""
    types = graph.where((F.col("p") == TYPE) & (F.col("o") == V.CLASS["type"])).select("s")
    labels = graph.where(F.col("p") == LABEL).join(types, "s", "left_semi").select(slug("o").alias("slug"), F.col("s").alias("term")).where("slug is not null").distinct()
    twice = labels.groupBy("slug").count().where("count > 1").take(1)
    if twice:
        raise IngestError("vocabulary", f"two terms share the label slug {twice[0][0]!r}")
    return labels


def resolve_refs(refs: DataFrame, targets: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(found, missed) of refs by the slug of their name. targets: target_slug, target.

    Each distinct name is slugged and looked up once, and the references meet their names.
    """
    # the slug is of an aggregate's result, so no filter on it is asked of every reference
    names = refs.groupBy(F.col(name).alias("__said")).agg(F.max(name).alias("__name")).withColumn("ref_slug", slug("__name")).drop("__name").join(targets, F.col("ref_slug") == F.col("target_slug"), "left")
    joined = refs.join(names, F.col(name).eqNullSafe(F.col("__said")), "left").drop("__said")
    return joined.where("target is not null"), joined.where("target is null")


def collisions(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """(keys..., n, places): keys that stand at more than one place."""
    return df.groupBy(*keys).agg(F.count_distinct(place).alias("n"), F.sort_array(F.collect_set(place)).alias("places")).where("n > 1")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., count): keys that several rows have."""
    return df.groupBy(*keys).count().where("count > 1")


def first_wins(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """(keys..., keep...): of each key the first row in order."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("first")).select(*keys, "first.*")


def last_pass_wins(df: DataFrame, key: str, value: str, turn: str | Column) -> DataFrame:
    """(key, value): of each key that of the last turn."""
    return df.groupBy(key).agg(F.max_by(value, turn).alias(value))


def ranked(members: DataFrame, sequence: str, order: str | Column, tie: str) -> DataFrame:
    """members with their ordinal, from 1 and without gaps, in their sequence; without an order they come last."""
    order = F.col(order) if isinstance(order, str) else order
    return members.withColumn("ordinal", F.row_number().over(Window.partitionBy(sequence).orderBy(order.asc_nulls_last(), tie)))


def assertion_rows(assertions: DataFrame, base: str) -> DataFrame:
    """assertions (target, attribute, path, key) with the uri of their node, a hash of what they say, so a rebuild gives the same graph."""
    return assertions.withColumn("uri", F.concat(F.lit(f"{base}assertion/"), F.sha2(F.concat_ws("|", "target", "attribute", "path", "key"), 256)))


def assertion_triples() -> list[tuple[Column, str, dict[str, Column]]]:
    """What each assertion row says."""
    uri = F.col("uri")
    return [
        (uri, TYPE, iri(V.CLASS["assertion"])),
        (uri, V.ASSIGNED_TO, iri(F.col("target"))),
        (uri, V.ASSIGNED, iri(F.col("attribute"))),
        (uri, V.USED_OBJECT, literal(F.col("path"), XSD + "string")),
    ]


def build(files: DataFrame, config: Config, vocabularies: dict[str, DataFrame] | None = None) -> Build:
    """The graph of a project's files. vocabularies: graphs by name; only active ones are used."""
    spark = files.sparkSession
    base = config.uri_base
    if not config.research:
        files = files.where(~F.col("role").isin("sources", "topic", "index"))
    store = Store(spark, "ingest")
    files_seen = Observation(f"files-{store.root}")
    read = files.observe(files_seen, F.count_if(F.col("role").isin(ROLES)).alias("files"))
    every, counts = store.save_counted(records(read, config.language), **{c: F.count_if(F.expr("reject is null and fatal is null") & (F.col("concept") == c)) for c in (*KEYS, "source", "finding", "anchor")})
    fatal = every.where("fatal is not null").orderBy("relpath", "pos").select("fatal").take(1)
    if fatal:
        raise IngestError("research", fatal[0][0])
    good = every.where("reject is null")
    of = lambda concept: good.where(F.col("concept") == concept)
    uri = lambda segment, s="slug": F.concat(F.lit(f"{base}{segment}/"), F.col(s) if isinstance(s, str) else s)

    clash = collisions(good.where("concept not in ('source', 'finding', 'anchor')"), ["concept", "slug"], "relpath").orderBy("concept", "slug").take(1)
    if clash:
        raise IngestError("slug_collision", f"{clash[0].concept} {clash[0].slug!r} is defined in {', '.join(clash[0].places)}")
    for what, key in (("source name", "slug"), ("finding id", "id")):
        keys = ["slug"] if key == "slug" else ["relpath", "id"]
        twice = repeated(of(what.split()[0]), keys).orderBy(*keys).take(1)
        if twice:
            raise IngestError("research", f"duplicate {what} {twice[0][key]!r}")

    entities = good.where(F.col("concept").isin(list(KEYS))).withColumn("uri", F.concat(F.lit(base), F.col("concept"), F.lit("/"), F.col("slug")))
    said: list[tuple[DataFrame, list]] = []
    prov: list[DataFrame] = []

    def emit(df: DataFrame, s: Column, p: str, obj: dict) -> None:
        """Notes a triple of each row; those of one frame are made in one pass over it."""
        mine = next((items for frame, items in said if frame is df), None)
        if mine is None:
            said.append((df, mine := []))
        mine.append((s, p, obj))

    def derive(df: DataFrame, target: Column, attribute: Column, key: str | None) -> None:
        """Provenance: who says so, at the line of key where that is known."""
        line = F.lit(None).cast("int") if key is None else F.try_element_at("lines", F.lit(key))
        prov.append(df.select(target.alias("target"), attribute.alias("attribute"), F.concat_ws(":", "relpath", line.cast("string")).alias("path"), F.lit(key or "").alias("key")))

    class_of = F.create_map(*[x for c in KEYS for x in (F.lit(c), F.lit(V.CLASS[c]))])
    emit(entities, F.col("uri"), TYPE, iri(class_of[F.col("concept")]))
    derive(entities, F.col("uri"), F.col("uri"), None)

    # characters: features, years, roles
    people = entities.where("concept = 'character'")
    free = people.select("uri", "relpath", "lines", F.explode("features").alias("label")).withColumn("node", F.concat("uri", F.lit("/feature/"), slug("label")))
    emit(free, F.col("uri"), V.HAS_FEATURE, iri(F.col("node")))
    emit(free, F.col("node"), TYPE, iri(V.CLASS["feature"]))
    emit(free, F.col("node"), LABEL, literal(F.col("label")))
    derive(free, F.col("uri"), F.col("node"), "features")
    for key, kind in (("born", "birth"), ("died", "death")):
        bio = people.where(F.col(key).isNotNull()).withColumn("node", F.concat("uri", F.lit(f"/feature/bio/{kind}")))
        emit(bio, F.col("uri"), V.HAS_FEATURE, iri(F.col("node")))
        emit(bio, F.col("node"), TYPE, iri(V.CLASS["feature"]))
        emit(bio, F.col("node"), V.HAS_TYPE, iri(f"{base}type/{kind}"))
        emit(bio, F.lit(f"{base}type/{kind}"), TYPE, iri(V.CLASS["type"]))
        emit(bio, F.col("node"), V.HAS_DIMENSION, iri(F.concat("node", F.lit("/dimension"))))
        emit(bio, F.concat("node", F.lit("/dimension")), TYPE, iri(V.CLASS["dimension"]))
        emit(bio, F.concat("node", F.lit("/dimension")), V.HAS_VALUE, literal(gyear(F.col(key)), XSD + "gYear"))
        derive(bio, F.col("uri"), F.col("node"), key)
    roles = people.select("uri", "relpath", "lines", F.explode("roles").alias("label")).withColumn("rslug", slug("label")).withColumn("node", F.concat("uri", F.lit("/role/"), F.col("rslug")))
    emit(roles, F.col("uri"), V.PLAYS, iri(F.col("node")))
    emit(roles, F.col("node"), TYPE, iri(V.CLASS["role"]))
    emit(roles, F.col("node"), LABEL, literal(F.col("label")))
    derive(roles, F.col("uri"), F.col("node"), "narrative_roles")

    active = {n: g for n, g in (vocabularies or {}).items() if n in config.vocabularies}
    untyped: list[DataFrame] = []

    def typed(df: DataFrame, vocabulary: str, slug_col: str, name_col: str) -> DataFrame | None:
        """df joined with the vocabulary's terms; misses are noted once a slug."""
        if vocabulary not in active:
            return None
        index = F.broadcast(vocabulary_index(active[vocabulary]).withColumnRenamed("slug", "vslug"))  # a packaged vocabulary: a few dozen labels
        joined = df.join(index, F.col(slug_col) == F.col("vslug"), "left")
        untyped.append(joined.where("term is null").groupBy(slug_col).agg(F.min(name_col).alias("name")).select(F.lit(vocabulary).alias("vocabulary"), "name"))
        hit = joined.where("term is not null")
        emit(hit, F.col("node"), V.HAS_TYPE, iri(F.col("term")))
        emit(hit, F.col("term"), TYPE, iri(V.CLASS["type"]))
        return hit

    if (hit := typed(roles, "greimas", "rslug", "label")) is not None:
        derive(hit, F.col("node"), F.col("term"), "narrative_roles")

    # references by slug
    unresolved: list[DataFrame] = []

    def resolve(refs: DataFrame, targets: DataFrame, field_: str) -> DataFrame:
        """refs (uri, relpath, lines, entity, name) with target; misses are noted."""
        found, missed = resolve_refs(refs, targets)
        unresolved.append(missed.select("relpath", F.lit(field_).alias("field"), "entity", "name").distinct())
        return found

    refs = lambda df, column: df.select("uri", "relpath", "lines", F.col("name").alias("entity"), F.explode(column).alias("name"))
    target = lambda df: df.select(F.col("slug").alias("target_slug"), F.col("uri").alias("target")).distinct()
    events = entities.where("concept = 'event'")
    for concept in ("event", "relationship"):
        part = resolve(refs(entities.where(F.col("concept") == concept), "participants"), target(people), "participants")
        emit(part, F.col("uri"), V.PARTICIPANT, iri(F.col("target")))
        derive(part.dropDuplicates(["uri", "target"]), F.col("uri"), F.col("target"), "participants")
    related = events.select("uri", "relpath", "lines", F.col("name").alias("entity"), F.explode("relations").alias("r"))
    for rel, predicate in V.RELATIONS.items():
        one = related.where(F.col("r.rel") == rel).select("uri", "relpath", "lines", "entity", F.col("r.name").alias("name"))
        hit = resolve(one, target(events), rel)
        emit(hit, F.col("uri"), predicate, iri(F.col("target")))
        derive(hit.dropDuplicates(["uri", "target"]), F.col("uri"), F.col("target"), rel)
    places = entities.where("concept = 'location' and setting is not null").select("uri", "relpath", "lines", F.col("name").alias("entity"), F.col("setting").alias("name"))
    placed = resolve(places, target(entities.where("concept = 'setting'")), "setting")
    emit(placed, F.col("uri"), V.GENERIC_LOCATION, iri(F.col("target")))
    derive(placed, F.col("uri"), F.col("target"), "setting")

    # intervals of events
    dated = events.where("begin is not null or end is not null").withColumn("span", F.concat("uri", F.lit("/time-span")))
    emit(dated, F.col("uri"), V.DURATION, iri(F.col("span")))
    emit(dated, F.col("span"), TYPE, iri(V.CLASS["interval"]))
    for kind in ("begin", "end"):
        bound = dated.where(F.col(kind).isNotNull()).withColumn("node", F.concat("span", F.lit(f"/{kind}"))).withColumn("dim", F.concat("node", F.lit("/dimension")))
        emit(bound, F.col("span"), V.TEMPORAL_LOCATION, iri(F.col("node")))
        emit(bound, F.col("node"), TYPE, iri(V.CLASS["interval"]))
        emit(bound, F.col("node"), V.HAS_TYPE, iri(f"{base}type/{kind}"))
        emit(bound, F.lit(f"{base}type/{kind}"), TYPE, iri(V.CLASS["type"]))
        emit(bound, F.col("node"), V.HAS_DIMENSION, iri(F.col("dim")))
        emit(bound, F.col("dim"), TYPE, iri(V.CLASS["dimension"]))
        emit(bound, F.col("dim"), V.HAS_VALUE, literal(gyear(F.col(kind)), XSD + "gYear"))

    # units, functions, sequences
    units = entities.where("concept = 'narrative-unit'")
    emit(units, F.col("uri"), LABEL, literal(F.col("name")))
    asked = refs(units, "roles").withColumn("ref_slug", slug("name"))
    role_nodes = roles.select(F.col("rslug").alias("target_slug"), F.col("node").alias("target")).distinct()
    played = resolve(asked.drop("ref_slug"), role_nodes, "roles")
    emit(played, F.col("uri"), V.REFERS_TO, iri(F.col("target")))
    derive(played, F.col("uri"), F.col("target"), "roles")
    used = units.select("uri", "relpath", "lines", F.posexplode("functions").alias("fpos", "label")).withColumn("fslug", slug("label")).withColumn("node", uri("narrative-function", "fslug"))
    emit(used, F.col("uri"), V.REFERS_TO, iri(F.col("node")))
    derive(used, F.col("uri"), F.col("node"), "functions")
    minted = first_wins(used, ["fslug", "node"], ["relpath", "fpos"], ["label", "relpath", "lines"])
    emit(minted, F.col("node"), TYPE, iri(V.CLASS["narrative-function"]))
    emit(minted, F.col("node"), LABEL, literal(F.col("label")))
    derive(minted, F.col("node"), F.col("node"), None)
    if (hit := typed(minted, "propp", "fslug", "label")) is not None:
        derive(hit, F.col("node"), F.col("term"), "functions")
    members = units.where("sequence is not null").withColumn("qslug", slug("sequence")).withColumn("seq", uri("narrative-sequence", "qslug"))
    members = ranked(members, "qslug", "ord", "slug").select("seq", "qslug", "sequence", "uri", "slug", "relpath", "ordinal")
    # a sequence is named as its first card in path order spells it, and its source is its first member's card
    sequences = members.groupBy("seq", F.col("qslug").alias("slug")).agg(F.min_by("sequence", "relpath").alias("name"), F.min_by("relpath", "ordinal").alias("relpath"))
    heads = sequences.select("seq", "relpath", F.lit(None).cast("map<string,int>").alias("lines"))
    emit(heads, F.col("seq"), TYPE, iri(V.CLASS["narrative-sequence"]))
    derive(heads, F.col("seq"), F.col("seq"), None)
    placed = members.select("seq", "uri", "ordinal").join(heads, "seq")
    emit(placed, F.col("seq"), V.PROPER_PART, iri(F.col("uri")))
    emit(placed, F.col("uri"), V.ORDINAL, literal(F.col("ordinal"), XSD + "integer"))
    derive(placed, F.col("seq"), F.col("uri"), "units")
    derive(placed, F.col("uri"), F.col("seq"), "order")

    # research
    sources = of("source").withColumn("uri", uri("source"))
    facet = lambda key: F.try_element_at("facets", F.lit(key))
    types = F.create_map(*[F.lit(x) for k, v in V.SOURCE_TYPES.items() for x in (k, f"{V.BW}source-type/{v}")])
    emit(sources, F.col("uri"), V.HAS_TYPE, iri(types[facet("type")]))
    emit(sources, F.col("uri"), V.BW + "reliability", iri(F.concat(F.lit(f"{V.BW}reliability/"), facet("reliability"))))
    for key, predicate in (("reliability_justification", "reliabilityJustification"), ("reference", "reference"), ("author", "author"), ("original_language", "originalLanguage"), ("original_quote", "originalQuote"), ("translation", "translation")):
        emit(sources, F.col("uri"), V.BW + predicate, literal(facet(key), XSD + "string"))
    emit(sources, F.col("uri"), V.BW + "accessDate", literal(facet("access_date"), XSD + "date"))
    minted_id = lambda kind, key: F.concat(F.lit(f"{base}{kind}/"), F.sha2(F.concat_ws("|", "relpath", F.lit(kind), key), 256))
    findings = of("finding").withColumn("uri", minted_id("finding", F.col("id")))
    backed = findings.select("uri", "relpath", "id", F.explode("sources").alias("name")).withColumn("ref_slug", slug("name"))
    backed = backed.join(sources.select(F.col("slug").alias("ref_slug"), F.col("uri").alias("source")), "ref_slug", "left")
    lost = backed.where("source is null").orderBy("relpath", "name").take(1)
    if lost:
        raise IngestError("research", f"unknown source {lost[0].name!r} in {lost[0].relpath}")
    emit(findings, F.col("uri"), TYPE, iri(V.CLASS["assertion"]))
    emit(findings, F.col("uri"), V.CLAIM, literal(F.col("claim"), XSD + "string"))
    emit(findings.where("claim is not null"), F.col("uri"), V.ASSERTED_BY, literal(F.col("asserted_by"), XSD + "string"))
    emit(backed, F.col("uri"), V.SUPPORTED_BY, iri(F.col("source")))
    emit(findings.where("open"), F.col("uri"), V.OPEN, literal(F.lit("true"), XSD + "boolean"))

    # narrative targets: of equal slugs the later pass counts; the timeline has a name of its own
    passes = F.create_map(*[F.lit(x) for i, c in enumerate(("character", "setting", "location", "object", "event")) for x in (c, i)])
    targets = last_pass_wins(entities.where(passes[F.col("concept")].isNotNull()), "slug", "uri", passes[F.col("concept")]).withColumnRenamed("uri", "target")
    targets = targets.where("slug <> 'timeline'").unionByName(spark.createDataFrame([("timeline", f"{base}timeline")], "slug string, target string")).withColumnRenamed("slug", "target_slug")
    warnings: list[DataFrame] = []

    def narrative(df: DataFrame, column: str) -> DataFrame:
        joined = df.withColumn("ref_slug", slug(column)).join(targets, F.col("ref_slug") == F.col("target_slug"), "left")
        warnings.append(joined.where(F.col(column).isNotNull() & F.col("target").isNull()).select("relpath", F.lit(column).alias("field"), F.col(column).alias("name")))
        return joined

    emit(narrative(findings, "bears_on"), F.col("uri"), V.ASSIGNED_TO, iri(F.col("target")))
    anchors = of("anchor").withColumn("uri", minted_id("anchor", F.col("pos").cast("string")))
    mine = findings.select(F.col("relpath").alias("frel"), F.col("id").alias("fid"), F.col("uri").alias("finding"))
    promoted = anchors.join(mine, (F.col("relpath") == F.col("frel")) & (F.col("promotes") == F.col("fid")), "left")
    lost = promoted.where("finding is null").orderBy("relpath", "pos").take(1)
    if lost:
        raise IngestError("research", f"anchor `promotes` an unknown finding {lost[0].promotes!r} in {lost[0].relpath}")
    promoted = narrative(promoted, "constrains")
    emit(promoted, F.col("uri"), TYPE, iri(V.CLASS["assertion"]))
    emit(promoted, F.col("uri"), V.PROMOTES, iri(F.col("finding")))
    emit(promoted, F.col("uri"), V.CONSTRAINS, iri(F.col("target")))
    spanned = promoted.where("begin is not null or end is not null").withColumn("node", F.concat("uri", F.lit("/time-span")))
    emit(spanned, F.col("uri"), V.HAS_TIME_SPAN, iri(F.col("node")))
    emit(spanned, F.col("node"), TYPE, iri(V.CLASS["time-span"]))
    emit(spanned, F.col("node"), V.BEGIN, literal(gyear(F.col("begin")), XSD + "gYear"))
    emit(spanned, F.col("node"), V.END, literal(gyear(F.col("end")), XSD + "gYear"))

    assertions = prov[0]
    for more in prov[1:]:
        assertions = assertions.unionByName(more)
    said.append((assertion_rows(assertions, base), assertion_triples()))

    def union(frames: list[DataFrame], schema: str) -> DataFrame:
        first = spark.createDataFrame([], schema)
        for df in frames:
            first = first.unionByName(df)
        return first

    soft = good.select("relpath", F.explode("soft").alias("field"), F.col("name"))
    unknown = good.select("relpath", F.explode("unknown").alias("key"))
    unknown = unknown.union(soft.where("field = 'order'").select("relpath", F.col("field").alias("key"))).distinct()
    notes = union([*warnings, soft.where("field = 'date'").select("relpath", "field", "name")], "relpath string, field string, name string")
    made, total = store.save_counted(graph_union(empty_graph(spark), *[triple_rows(df, items) for df, items in said]), triples=F.count(F.lit(1)))
    return Build(
        good,
        made,
        every.where("reject is not null").select("relpath", F.col("reject").alias("reason")),
        unknown,
        union(unresolved, "relpath string, field string, entity string, name string"),
        union(untyped, "vocabulary string, name string"),
        notes,
        findings.select("uri", "id", "relpath"),
        anchors.select("uri", F.col("promotes").alias("promotes_id"), F.col("constrains").alias("constrains_name"), "relpath"),
        config,
        sequences.withColumnRenamed("seq", "uri"),
        files_seen.get["files"],
        counts | total,
    )
