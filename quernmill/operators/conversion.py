"""Raw corpora to uniform samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernmill.functions import text as T

SPANS = "array<struct<start:int,end:int>>"
RELATIONS = "array<struct<head:int,tail:int,rel:string>>"
#: Kinds of relations by their public code.
RELATION_NAMES = dict(
    sorted(
        x.split(":")
        for x in (
            "P1198:unemployment_rate P582:end_time P580:start_time P577:publication_date P576:dissolved P571:inception P570:date_of_death P569:date_of_birth "
            "P17:country P27:country_of_citizenship P495:country_of_origin P205:basin_country P36:capital P1376:capital_of P30:continent P276:location P131:located_in_admin_territory P150:contains_admin_territory P706:located_on_terrain_feature P206:located_in_body_of_water P403:mouth_of_watercourse P840:narrative_location P159:headquarters_location P740:location_of_formation P937:work_location P551:residence P190:sister_city P1336:territory_claimed_by P1001:jurisdiction "
            "P3373:sibling P40:child P26:spouse P25:mother P22:father P20:place_of_death P19:place_of_birth P69:educated_at P108:employer P39:position_held P102:member_of_political_party P140:religion P172:ethnic_group P166:award_received P800:notable_work P1412:languages_spoken P607:conflict P241:military_branch P54:member_of_sports_team P463:member_of P737:influenced_by "
            "P6:head_of_government P35:head_of_state P194:legislative_body P37:official_language P488:chairperson P112:founded_by P127:owned_by P749:parent_organization P355:subsidiary P137:operator P1056:product P118:league "
            "P50:author P57:director P58:screenwriter P86:composer P161:cast_member P162:producer P170:creator P175:performer P176:manufacturer P178:developer P123:publisher P264:record_label P272:production_company P449:original_network P676:lyrics_by P674:characters P136:genre P364:original_language P400:platform P179:series "
            "P31:instance_of P279:subclass_of P361:part_of P527:has_part P171:parent_taxon P155:follows P156:followed_by P1365:replaces P1366:replaced_by P807:separated_from P710:participant P1344:participant_of"
        ).split()
    )
)
ENTITY_TYPES = {"LOC": "location", "MISC": "object", "NUM": "quantity", "ORG": "organization", "PER": "person", "TIME": "temporal"}
#: Question and answer by code, with h and t for head and tail.
TEMPLATES = {
    code: tuple(text.split(" / "))
    for code, text in (
        line.split(" = ")
        for line in """P800 = What is a notable work by {h}? / {t} is a notable work by {h}.
P740 = Where was {h} formed? / {h} was formed in {t}.
P577 = When was {h} published? / {h} was published on {t}.
P571 = When was {h} established? / {h} was established in {t}.
P570 = When did {h} die? / {h} died on {t}.
P569 = When was {h} born? / {h} was born on {t}.
P495 = What country is {h} from? / {h} is from {t}.
P276 = Where is {h} located? / {h} is located at {t}.
P178 = Who developed {h}? / {h} was developed by {t}.
P176 = Who manufactured {h}? / {h} was manufactured by {t}.
P175 = Who performed {h}? / {h} was performed by {t}.
P170 = Who created {h}? / {h} was created by {t}.
P161 = Who starred in {h}? / {t} starred in {h}.
P159 = Where is the headquarters of {h}? / The headquarters of {h} is in {t}.
P131 = Where is {h} located? / {h} is located in {t}.
P127 = Who owns {h}? / {h} is owned by {t}.
P112 = Who founded {h}? / {h} was founded by {t}.
P108 = Who does {h} work for? / {h} works for {t}.
P69 = Where was {h} educated? / {h} was educated at {t}.
P57 = Who directed {h}? / {h} was directed by {t}.
P50 = Who wrote {h}? / {h} was written by {t}.
P36 = What is the capital of {h}? / The capital of {h} is {t}.
P27 = What is the nationality of {h}? / {h} is from {t}.
P26 = Who is the spouse of {h}? / {t} is the spouse of {h}.
P20 = Where did {h} die? / {h} died in {t}.
P19 = Where was {h} born? / {h} was born in {t}.
P17 = What country is {h} in? / {h} is in {t}.""".splitlines()
    )
}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def normal_concepts(column: str) -> Column:
    """Concepts as lists: a text that holds a JSON list becomes it, another a list of itself."""
    return F.transform(F.col(column), lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array(c)))


def expand_entries(samples: DataFrame) -> DataFrame:
    """A statement to be responded to becomes two rows: itself, without a response, and as a question with one.

    Columns: text, entities, entity_spans, should_respond, response and any others.
    """
    rest = [c for c in samples.columns if c not in ("text", "entity_spans", "should_respond", "response")]
    # flat columns, each of which the optimizer computes once
    statement, question = F.col("_statement"), F.col("_question")
    samples = samples.withColumn("_statement", (F.coalesce("should_respond", F.lit(0)) == 1) & ~T.is_question("text"))
    samples = samples.withColumn("_question", F.when(statement, T.statement_to_question("text")))
    as_is = F.struct(F.col("text"), F.col("entity_spans"), F.coalesce("should_respond", F.lit(0)).alias("should_respond"), F.col("response"), F.lit("as_is").alias("form"))
    silent = F.struct(F.col("text"), F.col("entity_spans"), F.lit(0).alias("should_respond"), F.lit(None).cast("string").alias("response"), F.lit("statement").alias("form"))
    asked = F.struct(
        question.alias("text"),
        T.recalculated_spans(question, "entities", "entity_spans").alias("entity_spans"),
        F.lit(1).alias("should_respond"),
        F.coalesce(F.nullif("response", F.lit("")), T.affirmation("text")).alias("response"),
        F.lit("question").alias("form"),
    )
    return samples.select(*rest, F.explode(F.when(statement, F.array(silent, asked)).otherwise(F.array(as_is))).alias("row")).select(*rest, "row.*")


def document_relations(docs: DataFrame) -> DataFrame:
    """Documents of sentences, mentions and labelled relations (title, sents, vertexSet, labels) to samples."""
    first = lambda v: F.element_at(v, 1)
    return docs.select(
        "title",
        F.array_join(F.flatten("sents"), " ").alias("text"),
        F.transform("vertexSet", lambda v: first(v)["name"]).alias("entities"),
        F.transform("vertexSet", lambda v: F.array(F.coalesce(_map(ENTITY_TYPES)[first(v)["type"]], F.lit("object")))).alias("concepts"),
        F.transform("labels", lambda r: F.struct(r["h"].alias("head"), r["t"].alias("tail"), F.coalesce(_map(RELATION_NAMES)[r["r"]], r["r"]).alias("rel"))).alias("relations"),
    )


def relation_questions(samples: DataFrame, most: int = 3) -> DataFrame:
    """Question and answer rows of the first ``most`` relations of a sample that have a template."""
    known = {RELATION_NAMES[c]: t for c, t in TEMPLATES.items()}
    ask, say = _map({k: t[0] for k, t in known.items()}), _map({k: t[1] for k, t in known.items()})
    usable = F.slice(F.filter("relations", lambda r: ask[r["rel"]].isNotNull()), 1, most)
    rows = samples.select("title", "entities", F.posexplode(usable).alias("place", "r"))
    head, tail = F.get("entities", F.col("r.head")), F.get("entities", F.col("r.tail"))
    fill = lambda t: F.replace(F.replace(t, F.lit("{h}"), head), F.lit("{t}"), tail)
    return rows.select("title", "place", F.col("r.rel").alias("relation"), fill(ask[F.col("r.rel")]).alias("question"), fill(say[F.col("r.rel")]).alias("answer"))


def find_relations(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """Pairs (subject, object) with the relation of the first triple (subject, relation, object, position) that joins them, or null."""
    first = triples.groupBy("subject", "object").agg(F.min_by("relation", "position").alias("relation"))
    return pairs.join(first, ["subject", "object"], "left")


def graph_questions(questions: DataFrame, triples: DataFrame, kinds: DataFrame) -> DataFrame:
    """Questions over a knowledge base (qid, question, answers, entities) to samples.

    Entities are those of the question, then answers not among them, an answer given twice twice; an
    entity's concept is its first kind by rank (kinds: name, kind, rank) or ``object``; all ordered
    pairs that a triple (subject, relation, object, position) joins are related, by the first one.
    """
    ents = questions.withColumn("all", F.concat("entities", F.filter("answers", lambda a: ~F.array_contains("entities", a))))
    each = ents.select("qid", F.posexplode("all").alias("pos", "name"))
    ranked = kinds.groupBy("name").agg(F.min_by("kind", "rank").alias("kind"))
    typed = each.join(ranked, "name", "left").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.array(F.coalesce("kind", F.lit("object"))).alias("c")))), lambda x: x["c"]).alias("concepts"))
    a, b = each.alias("a"), each.alias("b")
    both = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.pos") != F.col("b.pos")))
    both = both.select(F.col("a.qid").alias("qid"), F.col("a.pos").alias("head"), F.col("b.pos").alias("tail"), F.col("a.name").alias("subject"), F.col("b.name").alias("object"))
    pairs = find_relations(both, triples).where("relation is not null")
    related = pairs.select("qid", F.struct("head", "tail", F.col("relation").alias("rel")).alias("r")).groupBy("qid").agg(F.array_sort(F.collect_list("r")).alias("relations"))
    n = F.size("answers")
    listed = F.when(n <= 1, F.array_join("answers", "")).otherwise(F.concat(F.array_join(F.slice("answers", F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at("answers", -1)))
    return ents.join(typed, "qid", "left").join(related, "qid", "left").select("qid", F.col("question").alias("text"), F.col("all").alias("entities"), "concepts", F.coalesce("relations", F.array().cast("array<struct<head:int,tail:int,rel:string>>")).alias("relations"), listed.alias("response"))


def instructions(items: DataFrame) -> DataFrame:
    """Rows of instruction sets in their many spellings to (text, response, source, category, ...) of those that have both."""
    have = set(items.columns)
    pick = lambda *names: T.first_truthy(*[n for n in names if n in have]) if have & set(names) else F.lit(None).cast("string")
    rows = items.select("*", pick("instruction", "prompt", "input").alias("_i"), pick("context", "input").alias("_c"), pick("response", "output", "completion").alias("_r"))
    text = F.when(F.col("_c").isNotNull() & (F.col("_c") != F.col("_i")), F.concat("_i", F.lit("\n\nContext: "), "_c")).otherwise(F.col("_i"))
    keep = [c for c in items.columns if c not in ("instruction", "prompt", "input", "context", "response", "output", "completion", "source", "category")]
    named = lambda c, d: (F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)).alias(c)
    return rows.where("_i is not null and _r is not null").select(*keep, text.alias("text"), F.col("_r").alias("response"), named("source", "instruction"), named("category", "general"))


def parse_triplets(markup: Column | str) -> Column:
    """(subject, relation, object) of linearised triples ``<triplet> S <subj> R <obj> O``; incomplete ones go."""
    text = F.col(markup) if isinstance(markup, str) else markup
    parts = F.split(text, "<triplet>")
    parsed = F.transform(
        F.filter(parts, lambda p: p.contains("<subj>") & p.contains("<obj>")),
        lambda p: F.struct(
            T.strip(F.split_part(p, F.lit("<subj>"), F.lit(1))).alias("subject"),
            T.strip(F.split_part(F.split_part(p, F.lit("<subj>"), F.lit(2)), F.lit("<obj>"), F.lit(1))).alias("relation"),
            T.strip(F.split_part(F.split_part(p, F.lit("<obj>"), F.lit(2)), F.lit("<"), F.lit(1))).alias("object"),
        ),
    )
    return F.filter(parsed, lambda t: (t["subject"] != "") & (t["relation"] != "") & (t["object"] != ""))


def triplet_samples(rows: DataFrame, text: str = "context", markup: str = "triplets") -> DataFrame:
    """Linearised triples to samples: entities in the order of first mention, relations by their places, all of type ``entity``."""
    own = rows.withColumn("_t", parse_triplets(markup)).where("size(_t) > 0 and trim(coalesce(context, '')) <> ''" if text == "context" else "size(_t) > 0")
    entities = F.array_distinct(F.flatten(F.transform("_t", lambda t: F.array(t["subject"], t["object"]))))
    own = own.withColumn("entities", entities)
    keep = [c for c in rows.columns if c not in (text, markup)]
    place = lambda e: (F.array_position("entities", e) - 1).cast("int")
    return own.select(
        *keep,
        F.col(text).alias("text"),
        "entities",
        F.transform("entities", lambda e: F.lit("entity")).alias("entity_types"),
        F.transform("entities", lambda e: T.find_span(text, e)).alias("entity_spans"),
        F.transform("_t", lambda t: F.struct(place(t["subject"]).alias("head"), place(t["object"]).alias("tail"), t["relation"].alias("rel"))).alias("relations"),
    )


def sample_json(samples: DataFrame, required: list[str], optional: list[str]) -> Column:
    """A sample as JSON: optional fields only where they hold something."""
    kinds = dict(samples.dtypes)

    def full(c: str) -> Column:
        if kinds[c].startswith(("array", "map")):
            return F.when(F.size(F.col(c)) > 0, F.col(c))
        return F.when(F.col(c) != "", F.col(c)) if kinds[c] == "string" else F.col(c)

    return F.to_json(F.struct(*[F.col(c) for c in required], *[full(c).alias(c) for c in optional]))


def needs_labels(entities: str = "entities", types: str = "entity_type_labels") -> Column:
    """Whether a sample lacks entities or their types."""
    return (F.coalesce(F.size(entities), F.lit(0)) <= 0) | (F.coalesce(F.size(types), F.lit(0)) <= 0)


def responds() -> Column:
    return (F.col("should_respond") == 1) & (T.strip(F.coalesce("response", F.lit(""))) != "")


def decoder_targets(tokens: Column | str, respond: Column | str, size: int, eos: int = 1, ignored: int = -100) -> Column:
    """Targets of a decoder: a response's tokens and the end mark, cut to ``size``; a silent row's end mark alone; the rest ignored."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    r = F.col(respond) if isinstance(respond, str) else respond
    own = F.when(r == 1, F.concat(F.slice(t, 1, size - 1), F.array(F.lit(eos)))).otherwise(F.array(F.lit(eos)))
    return F.slice(F.concat(own, F.array_repeat(F.lit(ignored), size)), 1, size)
