"""Entity resolution, parsing, search and conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from awardlens.functions import text as fn
from awardlens.operators import resolve as op
from awardlens.operators import vectors
from awardlens.operators.settle import settled
from awardlens.plans.registry import registry
from awardlens.sources.tables import Domain, oracle

QUERIES, ORACLES, query = registry()


def cells(d: Domain) -> DataFrame:
    """ref, contractor: the names of each focus contract's firms in one cell, with markers."""
    s = d.firms.select("firm", "name")
    k = F.col("firm")
    tag = (
        F.when(k % 13 == 0, F.concat(F.lit(" ([REVOKED] "), k.cast("string"), F.lit(")")))
        .when(k % 11 == 0, F.concat(F.lit(" (FORMERLY: OLD "), k.cast("string"), F.lit(") ("), k.cast("string"), F.lit(")")))
        .when((k % 7 == 0) & (F.col("ref") % 2 == 0), F.lit(""))
        .otherwise(F.concat(F.lit(" INC. ("), k.cast("string"), F.lit(")")))
    )
    named = d.focus.select("ref", "firm").join(s, "firm").select("ref", "firm", F.concat("name", tag).alias("part"))
    listed = named.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("firm", "part"))).alias("p"))
    return listed.select("ref", F.array_join(F.transform("p", lambda x: x["part"]), " / ").alias("contractor"))


_CELLS = r"""cells AS (SELECT ref, string_agg(part, ' / ' ORDER BY firm) AS contractor FROM (SELECT ref, f.firm, name || CASE WHEN f.firm % 13 = 0 THEN ' ([REVOKED] ' || f.firm || ')'
 WHEN f.firm % 11 = 0 THEN ' (FORMERLY: OLD ' || f.firm || ') (' || f.firm || ')' WHEN f.firm % 7 = 0 AND ref % 2 = 0 THEN '' ELSE ' INC. (' || f.firm || ')' END AS part FROM focus f JOIN firms USING (firm)) GROUP BY ref),
raws AS (SELECT ref, CAST(i - 1 AS INT) AS position, trim(p[i]) AS raw FROM (SELECT ref, string_split(contractor, ' / ') AS p, unnest(generate_series(1, len(string_split(contractor, ' / ')))) AS i FROM cells)),
parsed AS (SELECT ref, position, raw, nullif(regexp_extract(raw, '\((?:\[REVOKED\]\s*)?(\d+)\)', 1), '') AS id, regexp_matches(raw, '(?i)\[REVOKED\]') AS revoked, nullif(trim(regexp_extract(raw, '(?i)FORMERLY:?\s*([^)]*)', 1)), '') AS former,
 trim(regexp_replace(regexp_replace(regexp_replace(raw, '\[REVOKED\]', ' ', 'g'), '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g'), ' /.-,') AS display,
 trim(upper(regexp_replace(regexp_replace(regexp_replace(raw, '\[REVOKED\]', ' ', 'g'), '\([^)]*\)', ' ', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) AS norm FROM raws WHERE raw <> ''),
keyed AS (SELECT * FROM (SELECT p.*, coalesce(id, known, CASE WHEN p.norm <> '' THEN 'n:' || p.norm END) AS key FROM parsed p LEFT JOIN (SELECT norm, min_by(id, (ref, position)) AS known FROM parsed WHERE id IS NOT NULL AND norm <> '' GROUP BY 1) f ON p.norm = f.norm)
 WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ref, key ORDER BY position) = 1)"""


@query(oracle("SELECT * FROM parsed", _CELLS))
def parse_contractors(d: Domain):
    return op.parsed(cells(d))


@query(oracle("SELECT ref, key, revoked FROM keyed", _CELLS))
def resolved_firms(d: Domain):
    return op.resolved(op.parsed(cells(d))).select("ref", "key", "revoked")


@query(oracle("""SELECT key, name, revoked, former, n_contracts FROM (SELECT key, display AS name FROM (SELECT key, display, row_number() OVER (PARTITION BY key ORDER BY n DESC, seen) AS k FROM (SELECT key, display, count(*) AS n, min((ref, position)) AS seen FROM keyed GROUP BY 1, 2)) WHERE k = 1)
 JOIN (SELECT key, bool_or(revoked) AS revoked, min_by(former, (ref, position)) FILTER (former IS NOT NULL) AS former, count(DISTINCT ref) AS n_contracts FROM keyed GROUP BY 1) USING (key)""", _CELLS))
def canonical_names(d: Domain):
    return op.canonical_names(op.resolved(op.parsed(cells(d))))


@query(oracle("SELECT count(*) AS n_cells, count(*) FILTER (regexp_matches(contractor, '\\[REVOKED\\]')) AS n_revoked FROM cells", _CELLS))
def revoked_headline(d: Domain):
    """Cells that carry the revoked tag, counted on raw text."""
    return cells(d).agg(F.count("*").alias("n_cells"), F.count(F.when(F.col("contractor").rlike(fn.REVOKED), 1)).alias("n_revoked"))


@query(oracle(r"""SELECT ref, TRY_CAST(nullif(string_split(regexp_replace(t, '[₱$,\s]', '', 'g'), '-')[1], '') AS DOUBLE) AS value FROM (SELECT ref, CASE ref % 5 WHEN 0 THEN '₱' || CAST(amount AS VARCHAR) WHEN 1 THEN '$ 1,234.50' WHEN 2 THEN CAST(amount AS VARCHAR) || '-9' WHEN 3 THEN 'n/a' ELSE '-5' END AS t FROM contracts)"""))
def money_parse(d: Domain):
    a = F.col("amount").cast("string")
    raw = F.when(F.col("ref") % 5 == 0, F.concat(F.lit("₱"), a)).when(F.col("ref") % 5 == 1, F.lit("$ 1,234.50")).when(F.col("ref") % 5 == 2, F.concat(a, F.lit("-9"))).when(F.col("ref") % 5 == 3, F.lit("n/a")).otherwise(F.lit("-5"))
    return d.contracts.select("ref", fn.money(raw).alias("value"))


def _pick(key, values):
    """One of several values by a number."""
    out = F.lit(values[-1]) if not hasattr(values[-1], "alias") else values[-1]
    for i, v in list(enumerate(values))[:-1][::-1]:
        out = F.when(key % len(values) == i, v if hasattr(v, "alias") else F.lit(v)).otherwise(out)
    return out


@query(oracle("""SELECT ref, CASE WHEN ref % 8 < 6 THEN award_date END AS day FROM contracts"""))
def date_parse(d: Domain):
    """Dates written in each known format, and two that none fits."""
    day = F.col("award_date")
    forms = ["MM/dd/yyyy", "yyyy-MM-dd", "dd-MMM-yy", "dd-MMM-yyyy", "MMMM dd, yyyy", "dd MMMM yyyy"]
    return d.contracts.select("ref", fn.parsed_date(_pick(F.col("ref"), [*(F.date_format(day, f) for f in forms), "soon", F.date_format(day, "yyyy/MM/dd")])).alias("day"))


@query(oracle("""SELECT ref, CASE ref % 10 WHEN 0 THEN 'completed' WHEN 1 THEN 'completed' WHEN 2 THEN 'on-going' WHEN 3 THEN 'on-going' WHEN 4 THEN 'not yet started' WHEN 5 THEN 'not yet started' WHEN 6 THEN 'terminated' WHEN 7 THEN 'suspended' WHEN 8 THEN 'for review' ELSE 'unknown' END AS grp FROM contracts"""))
def status_norm(d: Domain):
    """Statuses as sources write them."""
    return d.contracts.select("ref", fn.status_group(_pick(F.col("ref"), ["Complete", " done ", "ON-GOING", "In-Progress", "Pending", "not started", "Canceled", "suspended", "For Review", F.lit(None).cast("string")])).alias("grp"))


@query(oracle("""SELECT ref, CASE ref % 12 WHEN 0 THEN 'public_bidding' WHEN 1 THEN 'public_bidding' WHEN 2 THEN 'shopping' WHEN 3 THEN 'negotiated' WHEN 4 THEN 'negotiated' WHEN 5 THEN 'limited_source' WHEN 6 THEN 'direct_retail' WHEN 7 THEN 'repeat_order' WHEN 8 THEN 'emergency' WHEN 11 THEN 'unknown' ELSE 'other' END AS method FROM contracts"""))
def method_norm(d: Domain):
    """Procurement methods as sources write them."""
    names = ["Competitive Bidding", "Public Bid (rebid)", "Small Value Procurement", "Direct Contracting", "Negotiated", "Limited Source Bidding", "Direct Retail Purchase", "Repeat Order", "Emergency Purchase", "Highway follow-on", "Bidding", F.lit(None).cast("string")]
    return d.contracts.select("ref", fn.method_class(_pick(F.col("ref"), names)).alias("method"))


_ENDS = [" Inc.", " Corp., Inc.", " Corporation", " Co.", " & Co.", " and Co", " Company", " Ltd", " Builders LLC", " Pte.", " Construction", " Limited; "]
_SHORT = "upper(p_name || CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDS)) + " END)"
for _end in (r"\bINC\.?$", r"\bCORP\.?$", r"\bCORPORATION$", r"\bCO\.?$", r"\bCOMPANY$", r"\bLTD\.?$", r"\bLIMITED$", r"\bLLC$", r"\bPTE\.?$", r"\bPVT\.?$", r"\b&\s*CO\.?$", r"\bAND\s*CO\.?$"):
    _SHORT = f"regexp_replace({'trim(' + _SHORT + ')' if _SHORT.startswith('upper') else _SHORT}, '{_end}', '')"


@query(oracle(rf"""SELECT p_partkey AS id, trim(regexp_replace(regexp_replace({_SHORT}, '[.,;:]', '', 'g'), '\s+', ' ', 'g')) AS name FROM part"""))
def company_names(d: Domain):
    """Names with each of the legal suffixes, and with words that are none."""
    return d.table("part").select(F.col("p_partkey").alias("id"), fn.company_name(F.concat("p_name", _pick(F.col("p_partkey"), _ENDS))).alias("name"))


_PERSONS = ["Maria de la Cruz, Jr.", "José Peña III", " juan  DEL\trosario ", "Ana De Los Santos Sr.", "Luz de las Alas, II", "O'Brien-Núñez, Ann", "DELA CRUZ IV"]
_NAMED = "CASE person % 8 WHEN 0 THEN 'MARIA DELA CRUZ' WHEN 1 THEN 'JOSÉ PEÑA' WHEN 2 THEN 'JUAN DEL ROSARIO' WHEN 3 THEN 'ANA DELOS SANTOS' WHEN 4 THEN 'LUZ DELAS ALAS' WHEN 5 THEN 'O''BRIEN-NÚÑEZ, ANN' WHEN 6 THEN 'DELA CRUZ' ELSE '' END"


@query(oracle(f"SELECT person, {_NAMED} || CASE WHEN person % 8 <> 7 THEN ' ' || surname ELSE '' END AS name FROM officials"))
def person_names(d: Domain):
    """Officials' names as sources write them, with particles, suffixes and letters beyond ASCII, before the family's name."""
    given = _pick(F.col("person"), [*_PERSONS, F.lit(None).cast("string")])
    return d.officials.select("person", fn.person_name(F.concat(given, F.lit(" "), F.lower("surname"))).alias("name"))


@query(oracle("SELECT person, CASE WHEN person % 2 = 0 THEN surname ELSE 'CLAN' || (person % 40) END AS found FROM officials"))
def surnames(d: Domain):
    """From `Surname, Given` and `Given Surname Jr.` forms."""
    full = F.when(F.col("person") % 2 == 0, F.concat(F.initcap("surname"), F.lit(", Ana"))).otherwise(F.concat(F.lit("Ana "), "surname", F.lit(" Jr.")))
    return d.officials.select("person", fn.surname(full).alias("found"))


@query(oracle(r"""SELECT firm, 'STREET ' || (firm % 7) || ' / ' || trim(upper(regexp_replace(home, '[^A-Za-z0-9]+', ' ', 'g'))) || ' / ' || trim(upper(regexp_replace(home_region, '[^A-Za-z0-9]+', ' ', 'g'))) AS locality FROM firms"""))
def localities(d: Domain):
    address = F.concat_ws(", ", F.lit("Unit 4"), F.concat(F.lit("Street "), (F.col("firm") % 7).cast("string")), "home", "home_region")
    return d.firms.select("firm", fn.locality(address).alias("locality"))


@query(oracle("""SELECT home_region AS locality, n, name AS member, CAST(row_number() OVER (PARTITION BY home_region ORDER BY name) AS INT) AS place FROM firms JOIN (SELECT home_region, count(*) AS n FROM firms GROUP BY 1 HAVING count(*) >= 2) USING (home_region)"""))
def locality_clusters(d: Domain):
    """Regions where two or more firms are registered, a row for each firm."""
    rows = d.firms.select(F.col("home_region").alias("locality"), F.col("name").alias("member"))
    counts = rows.groupBy("locality").agg(F.count("*").alias("n")).where("n >= 2")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("locality").orderBy("member"))).join(counts, "locality").select("locality", "n", "member", "place")


@query(oracle("""SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS similarity FROM (SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.name < y.name)
 WHERE round(jaro_winkler_similarity(a, b), 6) >= 0.85""", "n AS (SELECT DISTINCT upper(p_name) AS name FROM part UNION SELECT DISTINCT upper(p_name) || 'S' FROM part)"))
def fuzzy_matches(d: Domain):
    """Like part names, as stand-ins for contractor names."""
    return op.fuzzy_matches(_names(d))


def _names(d: Domain) -> DataFrame:
    p = d.table("part")
    return p.select(fn.company_name(F.col("p_name")).alias("name")).union(p.select(fn.company_name(F.concat("p_name", F.lit("s Inc.")))))


@query(oracle("""SELECT name, canonical, similarity FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, canonical) AS k FROM (SELECT CASE WHEN canonical = a THEN b ELSE a END AS name, canonical, similarity FROM
 (SELECT *, CASE WHEN length(a) > length(b) THEN a WHEN length(b) > length(a) THEN b ELSE least(a, b) END AS canonical FROM (SELECT x.name AS a, y.name AS b, round(jaro_winkler_similarity(x.name, y.name), 6) AS similarity FROM n x JOIN n y ON x.name < y.name) WHERE similarity >= 0.92))) WHERE k = 1""", "n AS (SELECT DISTINCT upper(p_name) AS name FROM part UNION SELECT DISTINCT upper(p_name) || 'S' FROM part)"))
def fuzzy_merge_map(d: Domain):
    return op.merge_map(op.fuzzy_matches(_names(d)))


def _entities(d: Domain) -> DataFrame:
    """Firms and parts as entities: id, label, aliases, value."""
    sums = d.awards.groupBy("firm").agg(F.sum("amount").cast("double").alias("value"))
    firms = d.firms.join(sums, "firm", "left").select(F.concat(F.lit("F"), "firm").alias("id"), F.col("name").alias("label"), F.array("home").alias("aliases"), F.coalesce("value", F.lit(0.0)).alias("value"))
    parts = d.table("part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.array("p_brand").alias("aliases"), F.col("p_retailprice").alias("value"))
    return firms.unionByName(parts)


_ENTITIES = """ents AS (SELECT 'F' || f.firm AS id, name AS label, home AS alias, coalesce(v, 0) AS value FROM firms f LEFT JOIN (SELECT firm, CAST(sum(amount) AS DOUBLE) AS v FROM awards GROUP BY 1) s ON f.firm = s.firm
 UNION ALL SELECT 'P' || p_partkey, p_name, p_brand, p_retailprice FROM part),
forms AS (SELECT *, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS l, trim(regexp_replace(lower(label || ' ' || alias), '[^a-z0-9]+', ' ', 'g')) AS h FROM ents)"""


@query(oracle("""SELECT id, label, CAST(CASE WHEN l = 'brand 12' THEN 0 WHEN starts_with(l, 'brand 12') THEN 1 WHEN contains(l, 'brand 12') THEN 2 ELSE 3 END AS INT) AS rank, value FROM forms WHERE contains(h, 'brand') AND contains(h, '12')""", _ENTITIES))
def entity_search_exact(d: Domain):
    return op.search_exact(_entities(d), "Bránd 12")


@query(oracle("""SELECT id, label, CAST(c AS INT) AS rank, value FROM (SELECT *, (SELECT min(CASE WHEN starts_with(w, 'supplir') THEN 0 ELSE levenshtein(w, 'supplir') END) FROM (SELECT unnest(string_split(l, ' ')) AS w)) AS c FROM forms) WHERE c <= 2 ORDER BY c, value DESC, id LIMIT 40""", _ENTITIES))
def entity_search_similar(d: Domain):
    return op.search_similar(_entities(d), "supplir")


@query(oracle(r"""SELECT p_partkey AS id, regexp_replace(p_type, '([+\-&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g') || '*' AS term FROM part"""))
def lucene_terms(d: Domain):
    return d.table("part").select(F.col("p_partkey").alias("id"), fn.lucene_prefix(F.col("p_type")).alias("term"))


@query(oracle("""SELECT firm AS id, CASE WHEN capital < 0 THEN 'revoked' WHEN firm % 10 = 0 THEN 'action' WHEN n IS NULL THEN 'dormant' ELSE 'normal' END AS status,
 round(least(16.0, greatest(2.5, sqrt(coalesce(v, 0) / 1000000) * 2.4)), 6) AS radius FROM firms f LEFT JOIN (SELECT firm AS k, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS v FROM focus GROUP BY 1) ON f.firm = k"""))
def node_status(d: Domain):
    """Status by precedence and the drawn radius of each firm."""
    sums = d.focus.groupBy("firm").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("v"))
    status = F.when(F.col("capital") < 0, "revoked").when(F.col("firm") % 10 == 0, "action").when(F.col("n").isNull(), "dormant").otherwise("normal")
    radius = F.least(F.lit(16.0), F.greatest(F.lit(2.5), F.sqrt(F.coalesce("v", F.lit(0.0)) / 1_000_000) * 2.4))
    return d.firms.join(sums, "firm", "left").select(F.col("firm").alias("id"), status.alias("status"), F.round(radius, 6).alias("radius"))


@query(oracle("""SELECT f.firm AS id, 'Contractor: ' || name || ' based in ' || home || CASE WHEN n IS NOT NULL THEN ' with ' || n || ' contracts' ELSE '' END AS description FROM firms f LEFT JOIN (SELECT firm AS k, count(*) AS n FROM awards GROUP BY 1) ON f.firm = k"""))
def entity_descriptions(d: Domain):
    """A sentence for each firm, parts without a value left out."""
    sums = d.awards.groupBy("firm").agg(F.count("*").alias("n"))
    text = F.concat_ws(" ", F.concat(F.lit("Contractor: "), "name"), F.concat(F.lit("based in "), "home"), F.concat(F.lit("with "), F.col("n").cast("string"), F.lit(" contracts")))
    return d.firms.join(sums, "firm", "left").select(F.col("firm").alias("id"), text.alias("description"))


@query(oracle("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'with|from') THEN 'relationship' WHEN regexp_matches(lower(text), 'that|this') THEN 'analytical' WHEN regexp_matches(lower(text), 'the') THEN 'entity' ELSE 'general' END AS intent,
 array_to_string(list_filter([CASE WHEN contains(lower(text), 'and') THEN 'contracts' END, CASE WHEN contains(lower(text), 'for') THEN 'registry' END], lambda x: x IS NOT NULL), ',') AS sources FROM conversations"""))
def intent_fallback(d: Domain):
    """Intent and sources of a message by keywords (common words, as the texts are invented)."""
    low = F.lower("text")
    intent = F.when(low.rlike("with|from"), "relationship").when(low.rlike("that|this"), "analytical").when(low.contains("the"), "entity").otherwise("general")
    sources = F.array_compact(F.array(F.when(low.contains("and"), "contracts"), F.when(low.contains("for"), "registry")))
    return d.table("conversations").select("conv_id", "turn", intent.alias("intent"), F.array_join(sources, ",").alias("sources"))


@query(oracle(r"""SELECT conv_id, CAST(grp AS BIGINT) AS grp, min(role) AS role, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n FROM (SELECT *, sum(CASE WHEN role = p THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM
 (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS p FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM said) WHERE back <= 10)) GROUP BY 1, 2 HAVING NOT (grp = 1 AND min(role) = 'assistant')""", "said AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 1 THEN 'user' ELSE role END AS role FROM conversations)"))
def merged_turns(d: Domain):
    """The last ten turns of each conversation, equal roles in a row merged, no leading answer (every third turn counts as the user's)."""
    kept = d.table("conversations").withColumn("role", F.when(F.col("turn") % 3 == 1, "user").otherwise(F.col("role")))
    by = Window.partitionBy("conv_id")
    last = kept.withColumn("back", F.row_number().over(by.orderBy(F.desc("turn")))).where("back <= 10")
    new = F.when(F.col("role") == F.coalesce(F.lag("role").over(by.orderBy("turn")), F.lit("")), 0).otherwise(1)
    grouped = last.withColumn("new", new).withColumn("grp", F.sum("new").over(by.orderBy("turn")))
    said = grouped.groupBy("conv_id", "grp").agg(F.min("role").alias("role"), F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"), F.count("*").alias("n"))
    rows = said.where("NOT (grp = 1 AND role = 'assistant')")
    return rows.select("conv_id", "grp", "role", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"), "n")


@query(oracle("""SELECT query, id, similarity, CAST(k AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS k FROM
 (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)) WHERE k <= 5"""))
def vector_cosine_topk(d: Domain):
    """The five nearest vectors of every fiftieth one."""
    v = d.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return op.cosine_top(v, v.where("id % 50 = 0"), 5)


@query()
def vector_cells_topk(d: Domain):
    """The five nearest vectors of every fiftieth one by an inverted file. Two hundred questions, compared with the exact way, tell how many cells give a recall of 0.95."""
    v = d.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked, index = settled(v.where("id % 50 = 0"), "cell-questions"), vectors.build(v)
    some = settled(asked.orderBy(F.xxhash64("id"), "id").limit(200), "cell-trial")
    exact = settled(op.cosine_top(v, some, 5), "cell-exact")
    return vectors.nearest(index, asked, 5, vectors.probes_for(index, some, exact, 5))


@query(oracle("""SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, o.home AS home, n.rank AS rank FROM (SELECT firm AS id, name, home FROM firms WHERE firm % 2 = 0) o
 FULL JOIN (SELECT id, max_by(name, version) AS name, max_by(rank, version) AS rank FROM (SELECT firm AS id, CASE WHEN ref % 2 = 0 THEN 'R' || ref END AS name, ref AS rank, ref AS version FROM focus WHERE firm % 3 = 0) GROUP BY 1) n ON o.id = n.id""".replace("max_by(name, version)", "max_by(coalesce(name, ''), version)").replace("THEN n.name ELSE", "THEN nullif(n.name, '') ELSE")))
def upsert_nodes(d: Domain):
    old = d.firms.where("firm % 2 = 0").select(F.col("firm").alias("id"), "name", "home")
    new = d.focus.where("firm % 3 = 0").select(F.col("firm").alias("id"), F.when(F.col("ref") % 2 == 0, F.concat(F.lit("R"), "ref")).alias("name"), F.col("ref").alias("rank"), F.col("ref").alias("version"))
    return op.upsert(old, new, ["id"])


@query(oracle("SELECT firm AS source, office AS target, max(ref) AS version FROM focus WHERE firm IN (SELECT firm FROM firms WHERE capital > 0) GROUP BY 1, 2"))
def upsert_edges(d: Domain):
    """Award edges between known firms and offices; the latest contract's edge stays."""
    nodes = d.firms.where("capital > 0").select(F.col("firm").cast("string").alias("id")).union(d.places.select("office"))
    edges = d.focus.select(F.col("firm").cast("string").alias("source"), F.col("office").alias("target"), F.col("ref").alias("version"))
    return op.upsert_edges(edges, nodes).select(F.col("source").cast("long").alias("source"), "target", "version")


@query(oracle("SELECT l_orderkey AS ref, l_linenumber AS line, min(l_suppkey) AS firm FROM lineitem GROUP BY 1, 2"))
def dedup_keep_first(d: Domain):
    """One line of each number on a contract: that of the smallest supplier."""
    rows = d.table("lineitem").select(F.col("l_orderkey").alias("ref"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("firm"))
    return op.keep_first(rows, ["ref", "line"], ["firm"])
