"""Building a library from facts: values, facts with twins, their allocation to items, and documents of them.

Facts are rows. Random choices are digests of a fact's or value's name and a seed, so that they are joins and
ranks over rows and do not depend on the order in which rows are worked on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions.text import contains_whole, value_text
from tarnfield.session import written
from tarnfield.sources.catalogue import BATCH, Catalogue


def chance(*parts: Column | str, seed: int = 0) -> Column:
    """A random-looking order of rows: a digest of their names and a seed."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed))).cast("binary"))


def values(kinds: DataFrame, taken: DataFrame) -> DataFrame:
    """kind, n, value: every value of each kind (kind, template, low, high) that no text of `taken` (text) holds as whole tokens.

    kinds is stated, and so are the few texts that a library already has: texts go out to the values.
    """
    all_values = kinds.select("kind", "template", F.explode(F.sequence("low", "high")).alias("n")).withColumn("value", value_text(F.col("template"), F.col("n")))
    # a value stands in a text only if its longest run of letters or digits does: an equi-join finds the few texts to look at
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([0-9a-z]+)"), F.lit(1))
    longest = F.element_at(F.array_sort(F.transform(runs(F.col("value")), lambda x: F.struct(F.length(x).alias("k"), x.alias("x")))), F.lit(-1))["x"]
    words = taken.select("text", F.explode(F.array_distinct(runs(F.col("text")))).alias("run"))
    used = all_values.withColumn("run", longest).join(words, "run").where(contains_whole(F.col("text"), F.col("value"))).select("kind", "n").distinct()
    return all_values.join(used, ["kind", "n"], "left_anti").select("kind", "n", "value")


def plan_facts(slots: DataFrame, free: DataFrame, seed: int = 0) -> DataFrame:
    """slots (fact_id, kind, low, high) each with a value of its kind within its range, no value twice.

    Slots of the narrowest range come first, so that these find values before wide ones use them up. Within a kind the
    ranges are worked through in that order, each a rank of its slots against a rank of the values that are left: as
    many steps as there are different ranges. A range with too few values is an error.
    """
    ranges = sorted(((r.kind, r.low, r.high) for r in slots.select("kind", "low", "high").distinct().collect()), key=lambda r: (r[2] - r[1], r))
    out, left = None, free
    for kind, low, high in ranges:
        mine = slots.where((F.col("kind") == kind) & (F.col("low") == low) & (F.col("high") == high))
        pool = left.where((F.col("kind") == kind) & F.col("n").between(low, high))
        by = Window.partitionBy("kind").orderBy("order")
        a = mine.withColumn("order", chance("fact_id", seed=seed)).withColumn("place", F.row_number().over(by)).drop("order")
        b = pool.withColumn("order", chance("value", seed=seed)).withColumn("place", F.row_number().over(by)).select("place", "n", "value")
        got = a.join(b, "place", "left").drop("place")
        if (short := got.where("value is null").count()) > 0:
            raise ValueError(f"{short} facts of kind {kind} between {low} and {high} have no value left")
        left = left.join(got.select("kind", "n"), ["kind", "n"], "left_anti")
        out = got if out is None else out.unionByName(got)
    return out


def with_twins(facts: DataFrame) -> DataFrame:
    """facts with twin: the fact_id of the attribute `twin_of` about the same entity, null where there is none."""
    other = facts.select(F.col("attribute").alias("o_attribute"), F.col("entity").alias("o_entity"), F.col("fact_id").alias("twin"))
    return facts.join(other, (F.col("twin_of") == F.col("o_attribute")) & F.col("entity").eqNullSafe(F.col("o_entity")), "left").drop("o_attribute", "o_entity")


def slots_of(attributes: DataFrame, entities: DataFrame) -> DataFrame:
    """The facts to be stated: each family of facts (attribute, scope, ...) with every entity of its scope, a general one with none; with fact_id."""
    with_entity = attributes.join(entities.select("scope", "entity"), "scope", "left")
    return with_entity.where((F.col("scope") == "general") | F.col("entity").isNotNull()).withColumn("fact_id", F.concat_ws(":", "attribute", "entity"))


def filled(template: Column, **values: Column) -> Column:
    """template with each {name} replaced; null where it is null, a null value leaves nothing."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def hold_out(slots: DataFrame, count: int, most: int = 3, seed: int = 0) -> DataFrame:
    """`count` of the slots (fact_id, attribute, ...), to be left unstated: the first by digest, at most `most` of an attribute. Too few are an error."""
    order = chance("fact_id", F.lit("held"), seed=seed)
    ranked = slots.withColumn("order_", order).withColumn("place_", F.row_number().over(Window.partitionBy("attribute").orderBy("order_", "fact_id")))
    held = ranked.where(F.col("place_") <= most).orderBy("order_", "fact_id").limit(count)
    if (found := held.count()) < count:
        raise ValueError(f"{count} facts are to be held out, {found} can be")
    return held.drop("order_", "place_")


def with_old_values(facts: DataFrame, free: DataFrame, count: int, seed: int = 0, scope: str = "product") -> DataFrame:
    """facts with old_value: `count` facts of a scope, by digest, get a second free value within their range for an earlier version."""
    some = facts.where(F.col("scope") == scope).orderBy(chance("fact_id", F.lit("old"), seed=seed), "fact_id").limit(count).select("fact_id", "kind", "low", "high")
    if (found := some.count()) < count:
        raise ValueError(f"{count} facts are to have an old value, {found} can")
    left = free.join(facts.select("kind", "n"), ["kind", "n"], "left_anti")
    old = plan_facts(some, left, seed + 1) if count else some.withColumn("value", F.lit(None).cast("string"))
    return facts.join(old.select("fact_id", F.col("value").alias("old_value")), "fact_id", "left")


def deleted_facts(products: DataFrame, accessories: list[str], sentence: str, free: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """Facts of deleted documents, one each: fact_id (also doc_id), attribute, scope, entity, kind, n, value, accessory, named.

    products: place (from 0), entity. Product and accessory are drawn by digest, so they may repeat; batch numbers may not.
    """
    n, low, high = products.count(), *BATCH[1:]
    if count and not (n and accessories):
        raise ValueError("deleted documents need a product and an accessory")
    pick = lambda salt, size: F.pmod(F.conv(F.substring(chance("fact_id", F.lit(salt), seed=seed), 1, 12), 16, 10).cast("long"), F.lit(max(size, 1)))
    slots = products.sparkSession.range(count).select(F.format_string("DEL-%02d", "id").alias("fact_id"), F.lit(BATCH[0]).alias("kind"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))
    drawn = plan_facts(slots, free, seed + 2) if count else slots.withColumn("n", F.lit(None).cast("long")).withColumn("value", F.lit(None).cast("string"))
    named = drawn.withColumn("place", pick("product", n)).withColumn("accessory", F.element_at(F.array(*map(F.lit, accessories or [""])), (pick("accessory", len(accessories)) + 1).cast("int")))
    rows = named.join(products.select("place", "entity"), "place")
    return rows.select(
        "fact_id", F.lit("deleted").alias("attribute"), F.col("fact_id").alias("doc_id"), F.lit("deleted").alias("scope"), F.lit("").alias("heading"), "entity", "kind", "low", "high", "n", "value", "accessory",
        filled(F.lit(sentence), accessory=F.col("accessory"), value=F.col("value"), entity=F.col("entity")).alias("named"),
    )


def postcode_facts(areas: DataFrame, template: str, doc_id: str = "", heading: str = "") -> DataFrame:
    """A fact for each region (region, place, area) whose value lists its areas, the last after "and"."""
    listed = areas.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "area"))), lambda x: x["area"]).alias("a"))
    n = F.size("a")
    value = F.when(n > 1, F.concat(F.array_join(F.slice("a", F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at("a", -1))).otherwise(F.element_at("a", 1))
    rows = listed.select(F.concat(F.lit("postcodes:"), F.col("region")).alias("fact_id"), F.col("region").alias("entity"), value.alias("value"))
    return rows.select("fact_id", F.lit("postcodes").alias("attribute"), F.lit(doc_id).alias("doc_id"), F.lit("postcode").alias("scope"), F.lit(heading).alias("heading"), "entity", F.lit("postcode").alias("kind"), "value", filled(F.lit(template), entity=F.col("entity"), areas=F.col("value")).alias("named"))


def fact_plan(catalogue: Catalogue, taken: DataFrame, held: int = 0, versions: int = 0, deleted: int = 0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(facts, held_out) of a catalogue: all it names, each with a value that no text of `taken` holds and no other fact has.

    facts: fact_id, attribute, doc_id, scope, heading, entity, kind, low, high, n, value, old_value, accessory, named, bare, lead, twin (sentences are
    filled in). held_out: attribute, doc_id, heading, entity, blank (the sentence with its value left open): product facts that
    no document states. Values go to the narrowest ranges first.
    """
    slots = written(slots_of(catalogue.attributes, catalogue.entities))
    out = written(hold_out(slots.where("scope = 'product'"), held, seed=seed))
    free = written(values(catalogue.kinds, taken))
    facts = written(plan_facts(slots.join(out.select("fact_id"), "fact_id", "left_anti"), free, seed))
    told = {c: filled(F.col(c), value=F.col("value"), entity=F.col("entity")) for c in ("named", "bare", "lead")}
    facts = written(with_old_values(with_twins(facts).withColumns(told), free, versions, seed))
    used = facts.select("kind", "value").unionByName(facts.where("old_value is not null").select("kind", F.col("old_value").alias("value")))
    left = free.join(used, ["kind", "value"], "left_anti")
    parts = [facts.drop("twin_of", "title", "section")]
    s = catalogue.settings
    if deleted:
        d = s.get("deleted") or {}
        parts.append(deleted_facts(catalogue.entities.where("scope = 'product'").select("place", "entity"), d.get("accessories") or [], d.get("sentence") or "", left, deleted, seed))
    named = [(p, x) for p in s.get("policies") or [] for x in p.get("region") or [] if x.get("postcodes")]
    if named:
        policy, section = named[0]
        parts.append(postcode_facts(catalogue.areas, section["postcodes"], policy["doc_id"], section["heading"]))
    all_facts = parts[0].withColumn("accessory", F.lit(None).cast("string"))
    for part in parts[1:]:
        all_facts = all_facts.unionByName(part, allowMissingColumns=True)
    blank = filled(F.col("named"), entity=F.col("entity"), value=F.lit("..."))
    return written(all_facts), out.select("attribute", "doc_id", "heading", "entity", blank.alias("blank"))


def pilot_scope(items: DataFrame, sections: DataFrame, per_type: int, documents: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(items, sections) of a pilot: the first items of each type's test split, and the sections of the named documents or that state a fact they need.

    items: item_id, type, split, facts and distractors (arrays of fact ids), first (a follow-up's first fact). sections: doc_id, fact_ids.
    """
    by = Window.partitionBy("type").orderBy("item_id")
    some = items.where("split = 'test'").withColumn("place_", F.row_number().over(by)).where(F.col("place_") <= per_type).drop("place_")
    ids = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("facts", "distractors")], F.array("first"))
    needed = some.select(F.explode(ids).alias("fact_id")).where("fact_id is not null").distinct()
    keyed = sections.withColumn("row_", F.monotonically_increasing_id())
    keyed = written(keyed)
    stating = keyed.select("row_", F.explode("fact_ids").alias("fact_id")).join(needed, "fact_id", "left_semi").select("row_").distinct().withColumn("states_", F.lit(True))
    kept = keyed.join(stating, "row_", "left").where(F.col("states_").isNotNull() | F.col("doc_id").isin(*documents))
    return some, kept.drop("row_", "states_")


#: Digests a fact's sibling wanted that are put in order, and tasks that an attribute's asked facts are dealt to.
EXPECTED, SHARES = 16, 8


def siblings(asked: DataFrame, facts: DataFrame, most: int, seed: int | None = None) -> DataFrame:
    """fact_id, sibling: for each asked fact at most `most` facts of its attribute about other entities, chosen by digest.

    Candidates are the facts of one attribute, and each pair has a digest. Of a fact with many candidates only those pairs are put in order
    whose digests are low enough for some EXPECTED of them; the few facts that fewer than `most` reach are ranked whole.
    """
    seeded = F.lit("" if seed is None else f":{seed}")
    digest = F.md5(F.concat(F.col("fact_id").cast("string"), F.lit(":"), F.col("sibling").cast("string"), seeded).cast("binary"))
    other = facts.select("attribute", F.col("entity").alias("o_entity"), F.col("fact_id").alias("sibling"))
    asked = asked.select("fact_id", "attribute", "entity")
    of = facts.groupBy("attribute", F.col("entity").alias("o_entity")).agg(F.count("*").alias("own"))
    every = of.groupBy("attribute").agg(F.sum("own").alias("n"))
    own = asked.join(every, "attribute").join(of.withColumnRenamed("attribute", "o_attribute"), (F.col("attribute") == F.col("o_attribute")) & F.col("entity").eqNullSafe(F.col("o_entity")), "left")
    n = F.col("n") - F.coalesce("own", F.lit(0))
    # g is beyond all digests
    limit = F.when(n <= EXPECTED * most, "g").otherwise(F.lower(F.lpad(F.hex(F.floor(F.lit(2.0**32) * EXPECTED * most / n).cast("long")), 8, "0")))
    limits = written(own.groupBy("fact_id").agg(F.max(limit).alias("limit"), F.sum(n).alias("n")))

    def first(asks: DataFrame, limited: bool) -> DataFrame:
        # an attribute's asked facts are dealt to several tasks, each of which reads its candidates
        dealt = asks.withColumn("share", F.pmod(F.xxhash64("fact_id"), F.lit(SHARES)).cast("int"))
        of_share = other.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        on = of_share.join(dealt.hint("shuffle_hash"), ["attribute", "share"]).where(~F.col("entity").eqNullSafe(F.col("o_entity")))
        if limited:
            on = on.where(digest < F.col("limit"))
        w = Window.partitionBy("fact_id").orderBy("digest", "sibling")
        return on.select("fact_id", "sibling", digest.alias("digest")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("fact_id", "sibling")

    found = written(first(asked.join(limits.select("fact_id", "limit"), "fact_id"), True))
    short = limits.join(found.groupBy("fact_id").agg(F.count("*").alias("found")), "fact_id", "left").where(F.coalesce("found", F.lit(0)) < F.least(F.lit(most), F.col("n")))
    rest = first(asked.join(short.select("fact_id"), "fact_id", "left_semi"), False)
    return found.join(short.select("fact_id"), "fact_id", "left_anti").unionByName(rest)


def wanted(targets: DataFrame, spare: float = 0.25) -> DataFrame:
    """targets (type, split, target, checked) with wanted: spares are added to types that a checker may reject."""
    return targets.withColumn("wanted", F.col("target") + F.when(F.col("checked"), F.ceil(F.col("target") * spare)).otherwise(0))


def allocate(facts: DataFrame, targets: DataFrame, order: list[str], seed: int = 0) -> DataFrame:
    """item_id, type, split, spare, fact_id: facts dealt to items, each fact once.

    facts: fact_id and, for each type, a boolean column fits_<type>. targets: as `wanted` gives them. Types choose in the
    given order, those that few facts fit first; each takes its first facts by digest. Too few facts are an error.
    """
    needs = {(r.type, r.split): (r.wanted, r.target) for r in targets.collect()}
    left, out = facts, None
    for kind in order:
        splits = [(s, *needs[(kind, s)]) for s in ("test", "dev") if (kind, s) in needs]
        total = sum(n for _, n, _ in splits)
        pool = left.where(F.col(f"fits_{kind}")).withColumn("order", chance("fact_id", F.lit(kind), seed=seed))
        first = pool.orderBy("order", "fact_id").limit(total)
        ranked = first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("order", "fact_id")) - 1)
        if (found := ranked.count()) < total:
            raise ValueError(f"{kind} needs {total} facts, {found} are free")
        begin = 0
        for split, n, target in splits:
            index = F.col("place") - begin
            prefix = "DEV-" if split == "dev" else ""
            mine = ranked.where(F.col("place").between(begin, begin + n - 1)).select(
                F.format_string(f"{prefix}{kind}-%03d", index).alias("item_id"), F.lit(kind).alias("type"), F.lit(split).alias("split"), (index >= target).alias("spare"), "fact_id",
            )
            out = mine if out is None else out.unionByName(mine)
            begin += n
        left = left.join(ranked.select("fact_id"), "fact_id", "left_anti")
    return out


def render(facts: DataFrame) -> DataFrame:
    """doc_id, body: a title and, under each heading, the sentences of its facts in order.

    facts: doc_id, title, section, heading, place, sentence.
    """
    parts = facts.groupBy("doc_id", "title", "section", "heading").agg(F.array_sort(F.collect_list(F.struct("place", "sentence"))).alias("s"))
    text = F.concat(F.lit("## "), F.col("heading"), F.lit("\n\n"), F.array_join(F.transform("s", lambda x: x["sentence"]), " "))
    sections = parts.groupBy("doc_id", "title").agg(F.array_sort(F.collect_list(F.struct("section", text.alias("t")))).alias("p"))
    return sections.select("doc_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")).alias("body"))


def superseded(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Earlier versions of documents (doc_id, version, body): the value of each change (doc_id, value, old_value) stands as it was.

    A value must stand once in its document; otherwise the version could not be told from the current one.
    """
    old = documents.join(changes, "doc_id")
    times = F.size(F.split("body", F.concat(F.lit("\\Q"), F.col("value"), F.lit("\\E")), -1)) - 1
    if (bad := old.where(times != 1).first()) is not None:
        raise ValueError(f"{bad.doc_id}: {bad.value} does not stand once")
    body = F.replace(F.col("body"), F.col("value"), F.col("old_value"))
    return old.select("doc_id", (F.col("version") - 1).alias("version"), body.alias("body"), F.lit("superseded").alias("status"))
