"""Every method, model family and chat template of the rendering, as digests of the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import render as R
from . import graph_render as GR
from .registry import Tables, query, with_parts

METHODS = (
    "zero_shot", "few_shot_2hop", "few_shot_similarity_smiles", "desc_only", "one_hop_subgraph_single", "one_hop_subgraph_sequence_desc", *R.SEQUENCE_METHODS,
)
KINDS = GR.KINDS
#: The first method with the same block and note: a sequence method is its three settings.
SAME = {m: next(o for o in METHODS if (R.SEQUENCE_METHODS.get(m, m), R.NOTES.get(m)) == (R.SEQUENCE_METHODS.get(o, o), R.NOTES.get(o))) for m in METHODS}


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


# Both sides of a pair are a part and its context; the second side has its name in small letters.
def sides(t: Tables):
    ctx = F.array(*[F.struct(F.lit(f"{k}s").alias("type"), F.col(k).alias("A"), F.col(k).alias("B")) for k in KINDS])
    told = t.part.select(F.col("p_partkey").alias("node"), "p_name", "p_type")
    return GR.context(t).withColumn("ctx", ctx).join(told, "node").withColumn("a", F.concat(F.lit("P"), "node")).withColumn("b", F.concat(F.lit("p"), "node"))


def block_of(method: str):
    return R.pair_block(
        method, F.col("a"), F.col("b"), F.col("ctx"), smiles_a=F.lit("C"), smiles_b=F.lit(None).cast("string"), is_a=F.pmod("node", F.lit(2)) == 0,
        key_name=F.concat(F.lit("S"), F.pmod("node", F.lit(50))), desc_a=F.concat(F.col("p_name"), F.lit(" ")), desc_b=F.col("p_type"),
    )


def listed(rows: DataFrame, node: str, digests: dict[tuple[str, ...], Column], *names: str) -> DataFrame:
    """A row for each entry: its words, then its column, as ``names``."""
    entry = lambda words, digest: F.struct(*[F.lit(w).alias(n) for w, n in zip(words, names)], digest.alias(names[-1]))
    return rows.select(node, F.explode(F.array(*[entry(*x) for x in digests.items()])).alias("__x")).select(node, "__x.*")


def _line(kind: str, names: str) -> str:
    said = f"array_to_string({names}, ', ')"
    return f"CASE WHEN {said} = 'unknown' THEN 'whose {kind} is unknown' ELSE 'whose {kind}s are ' || {said} END"


def _masked(k: str) -> str:
    first = f"list_position(list_transform({k}, lambda z: z <> 'unknown'), true)"
    equal = f"list_transform({k}, lambda x: CASE WHEN x = 'S' || (node % 50) THEN '{R.ENTITY}' ELSE x END)"
    return f"CASE WHEN node % 2 = 0 THEN {equal} ELSE list_transform({k}, lambda x, i: CASE WHEN i = {first} THEN '{R.ENTITY}' ELSE x END) END"


def block_sql(method: str) -> str:
    """The block of a method, in pieces joined by ||; a, b, p_name, p_type and the kinds are columns."""
    nl = "chr(10)"

    def whole(one: str, two: str) -> str:
        return f"'### [Prediction]:' || {nl} || {one} || {nl} || {two} || {nl} || '### Answer: '"

    def told(side: str, name: str, lines: list[str]) -> str:
        return f"'Drug {side}: ' || {name} || {nl} || " + f" || {nl} || ".join(lines) + " || '.'"

    if method == "zero_shot":
        return whole("'Drug A: ' || a", "'Drug B: ' || b")
    if method == "few_shot_2hop":
        return whole("'Query Drug A: ' || a", "'Query Drug B: ' || b")
    if method == "few_shot_similarity_smiles":
        return whole("'Drug A: ' || a || ', SMILES: C'", "'Drug B: ' || b || ', SMILES: None'")
    if method == "desc_only":
        return whole(f"'Drug A: ' || a || {nl} || 'Clinical description: ' || trim(p_name)", f"'Drug B: ' || b || {nl} || 'Clinical description: ' || trim(p_type)")
    plain = [_line(k, k) for k in KINDS]
    if method == "one_hop_subgraph_single":
        facts = lambda name: "array_to_string(flatten([" + ", ".join(f"list_transform({k}, lambda x: '(' || {name} || ', has {k}s, ' || x || ')')" for k in KINDS) + "]), ', ')"
        one = lambda s, name: f"'Drug {s}: ' || {name} || {nl} || 'Drug {s}''s Facts: ' || {facts(name)}"
        return whole(one("A", "a"), one("B", "b"))
    if method == "one_hop_subgraph_sequence_desc":
        named = lambda name, text: f"{name} || {nl} || 'Clinical description: ' || trim({text})"
        return whole(told("A", named("a", "p_name"), plain), told("B", named("b", "p_type"), plain))
    names, entities, hidden = R.SEQUENCE_METHODS[method]
    lines = [_line(k, _masked(k) if entities else "['unknown']" if hidden and k in ("enzyme", "transporter") else k) for k in KINDS]
    return whole(told("A", sql_text(R.DRUG_A) if names else "a", lines), told("B", sql_text(R.DRUG_B) if names else "b", lines))


SIDES_SQL = with_parts("kg") + f", {GR.CTX_SQL}, sd AS MATERIALIZED (SELECT cx.*, p_name, p_type, 'P' || node AS a, 'p' || node AS b FROM cx JOIN part ON p_partkey = node)"


@query("r06_all_pair_blocks", SIDES_SQL + " " + " UNION ALL ".join(f"SELECT node, '{m}' AS method, md5({block_sql(m)}) AS block_md5 FROM sd" for m in METHODS))
def r06_all(t: Tables):
    made = sides(t).select("node", *[F.md5(block_of(m).cast("binary")).alias(m) for m in sorted({*SAME.values()})])
    return listed(made, "node", {(m,): F.col(SAME[m]) for m in METHODS}, "method", "block_md5")


def prompt_sql(method: str, family: str, block: str) -> str:
    note = R.NOTES.get(method, R.KG_NOTE if method in R.SEQUENCE_METHODS else "")
    user = f"trim({sql_text(note + R.CONSTRAINT)} || {block}, ' ' || chr(10) || chr(9) || chr(13))"
    system, parts = sql_text((R.TASK + R.INSTRUCTION).strip()), R.CHAT[family]
    wrap = lambda role, text: f"{sql_text(parts[role][0])} || {text} || {sql_text(parts[role][1])}"
    lead = wrap("user", f"{system} || chr(10) || chr(10) || {user}") if family == "gemma" else f"{wrap('system', system)} || {wrap('user', user)}"
    return f"{lead} || {wrap('assistant', sql_text(' Yes'))}"


@query(
    "r10_all_prompts",
    SIDES_SQL + ", bl AS MATERIALIZED (SELECT node, " + ", ".join(f"{block_sql(m)} AS b{i}" for i, m in enumerate(METHODS)) + " FROM sd) "
    + " UNION ALL ".join(f"SELECT node, '{m}' AS method, '{f}' AS family, md5({prompt_sql(m, f, f'b{i}')}) AS prompt_md5 FROM bl" for i, m in enumerate(METHODS) for f in R.FAMILIES),
)
def r10_all(t: Tables):
    """Each text is made and digested once, for all methods that it is the text of."""
    first = sorted({*SAME.values()})
    blocks = sides(t).select("node", *[block_of(m).alias(m) for m in first])
    text = lambda m, f: R.prompt(m, f, F.col(m), answer=R.answer_of(F.lit(1)))
    made = blocks.select("node", *[F.md5(text(m, f).cast("binary")).alias(f"{f}:{m}") for m in first for f in R.FAMILIES])
    return listed(made, "node", {(m, f): F.col(f"{f}:{SAME[m]}") for m in METHODS for f in R.FAMILIES}, "method", "family", "prompt_md5")


def chat_sql(template: str) -> str:
    """(conv_id, text): the turns of each conversation; one template puts the system text before the first user turn."""
    parts, text = R.CHAT[template], "coalesce(text, '')"
    wrap = lambda role, said: f"{sql_text(parts[role][0])} || {said} || {sql_text(parts[role][1])}"
    order = "turn, role, coalesce(text, '')"
    if template != "gemma":
        arms = " ".join(f"WHEN '{r}' THEN {wrap(r, text)}" for r in parts)
        return f"SELECT conv_id, string_agg(CASE role {arms} ELSE '' END, '' ORDER BY {order}) AS text FROM conversations GROUP BY 1"
    lead = "CASE WHEN n = f AND s <> '' THEN s || chr(10) || chr(10) || x ELSE x END"
    return f"""SELECT c.conv_id, CASE WHEN max(f) IS NULL AND max(s) <> '' THEN {wrap("user", "max(s)")}
  ELSE coalesce(string_agg(CASE role WHEN 'user' THEN {wrap("user", lead)} ELSE {wrap("assistant", "x")} END, '' ORDER BY n) FILTER (n IS NOT NULL), '') END AS text
FROM (SELECT conv_id, coalesce(trim(string_agg({text}, chr(10) ORDER BY {order}) FILTER (role = 'system')), '') AS s FROM conversations GROUP BY 1) c
LEFT JOIN (SELECT *, min(CASE WHEN role = 'user' THEN n END) OVER (PARTITION BY conv_id) AS f FROM
  (SELECT conv_id, role, {text} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY {order}) AS n FROM conversations WHERE role IN ('user', 'assistant'))) m
ON m.conv_id = c.conv_id GROUP BY 1"""


@query("r11_all_chat_formats", " UNION ALL ".join(f"SELECT conv_id, '{c}' AS template, md5(text) AS text_md5 FROM ({chat_sql(c)})" for c in R.CHAT))
def r11_all(t: Tables):
    """Turns are brought together once for all templates."""
    message = F.struct(F.col("turn").alias("t"), F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    talks = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("m"))
    texts = F.array(*[F.struct(F.lit(c).alias("template"), F.md5(R.turns(F.col("m"), c).cast("binary")).alias("text_md5")) for c in R.CHAT])
    return talks.select("conv_id", F.explode(texts).alias("x")).select("conv_id", "x.*")
