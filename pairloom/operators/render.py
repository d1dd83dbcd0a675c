"""Text rendering of pairs: context sentences, masks, examples, prompts and chat templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import with_full_stop

# Fixed values -------------------------------------------------------------------------------
TASK = "Task: Binary Classification of Drug-Drug Interactions (DDI)\n"
INSTRUCTION = (
    "You are an expert pharmacologist and clinical research assistant. Your objective is to determine whether a clinically significant "
    "drug-drug interaction (DDI) exists between the two provided drugs identified by the '[Prediction]' tag. Consider potential "
    "pharmacokinetic interactions and pharmacodynamic interactions in your assessment."
)
KG_NOTE = (
    "This inference is augmented by external biomedical knowledge transformed into natural language descriptions. Structured Knowledge Graph "
    "facts regarding each drug have been linearized into coherent sentences grouping biological associations by category (e.g., whose targets "
    "are xxx, xxx, and xxx). Utilize these semantic descriptions to identify potential interaction mechanisms.\n"
)
NOTES = {
    "zero_shot": (
        "This is a Zero-Shot inference mode. No external context, drug descriptions, or labeled examples are provided. You must rely "
        "exclusively on your pre-trained internal knowledge regarding drug mechanisms and chemical knowledge to make the prediction.\n"
    ),
    "few_shot_similarity_smiles": (
        "This is a Few-Shot inference task enhanced by molecular structural similarity. You are provided with reference examples selected based "
        "on high SMILES similarity (Morgan fingerprints) to the target drug pair. Then you can infer the interaction status of the target pair "
        "by analyzing the shared molecular substructures and interaction patterns observed in these structural analogs.\n"
    ),
    "one_hop_subgraph_single": (
        "This inference is augmented by external biomedical knowledge. For each drug, you are provided with a set of explicit 1-hop Knowledge "
        "Graph Triples (Subject, Relation, Object) representing its immediate biological associations (e.g., (Drug A, has targets, xxx "
        "target)). Integrate these structured facts with your internal knowledge to assess the likelihood of an interaction.\n"
    ),
    "one_hop_subgraph_sequence_desc": (
        "This inference is augmented by external biomedical knowledge combined with a per-drug clinical pharmacology description. Structured "
        "Knowledge Graph facts regarding each drug have been linearized into coherent sentences grouping biological associations by category "
        "(e.g., whose targets are xxx, xxx, and xxx). In addition, each drug is accompanied by a 150-200 word clinical description covering "
        "pharmacological class, primary indications, physiological (organ / tissue-level) mechanism of action, dosing, common adverse effects, "
        "and contraindications. The description is generated independently of the Knowledge Graph and does not restate protein-level facts "
        "already present in the graph. Utilize both the graph facts and the clinical description together to identify potential interaction "
        "mechanisms.\n"
    ),
    "desc_only": (
        "This inference is augmented by a per-drug clinical pharmacology description. Each drug is accompanied by a 150-200 word clinical "
        "description covering pharmacological class, primary indications, physiological (organ / tissue-level) mechanism of action, dosing, "
        "common adverse effects, and contraindications. No structured biomedical knowledge graph (targets, enzymes, transporters, carriers, "
        "pathways) is provided. The description is generated independently of any protein-level knowledge graph and does not contain protein / "
        "enzyme / transporter / carrier or interacting-drug names. Utilize this clinical description together with your internal "
        "pharmacological knowledge to identify potential interaction mechanisms.\n"
    ),
    "few_shot_2hop": (
        "This task utilizes a Mechanism-Aware Few-Shot strategy. The provided reference examples are not selected randomly, they are retrieved "
        "based on shared biological entities (targets, transporters, enzymes) from a biomedical Knowledge Graph. Specifically, the reference "
        "drugs share critical protein associations with the query drugs (with tag '[Prediction]'), implying a potential 2nd-order mechanistic "
        "similarity (Query Drug -> Shared Protein <- Reference Drug). Use these mechanistically related examples to infer the interaction "
        "status of the target pair.\n"
    ),
}
CONSTRAINT = (
    "Output Constraint: Respond strictly with exactly one token: ' Yes' or ' No'. Do not provide any explanations, confidence scores, "
    "punctuation, or additional text.\n"
)
#: context methods: (names masked, entities masked, protein types hidden)
SEQUENCE_METHODS = {
    "one_hop_subgraph_sequence": (False, False, False), "one_hop_subgraph_sequence_mask_name": (True, False, False),
    "one_hop_subgraph_sequence_mask_pk": (False, False, True), "ohs_mask_name": (True, False, False), "ohs_mask_entity": (False, True, False),
    "ohs_mask_name_entity": (True, True, False), "ohs_full": (False, False, False), "ohs_full_mask_name": (True, False, False),
    "ohs_full_mask_entity": (False, True, False), "ohs_full_mask_name_entity": (True, True, False),
}
ALIASES = {
    "Zero_Shot": "zero_shot", "Zero_Shot_Sequence": "zero_shot",
    "exp_100d_One_Hop_Subgraph_Sequence_Mask_Name": "one_hop_subgraph_sequence_mask_name",
    "exp_100d_One_Hop_Subgraph_Sequence_Mask_PK": "one_hop_subgraph_sequence_mask_pk",
}
FAMILIES = ("qwen", "llama", "gemma", "mistral")
CHAT_NAMES = (("llama", "llama"), ("qwen", "qwen"), ("mistral", "mistral"), ("deepseek", "llama"), ("chatglm", "chatglm"), ("baichuan", "baichuan"), ("gemma", "gemma"))
#: template -> role -> (before, after)
CHAT = {
    "llama": {
        "system": ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n", "<|eot_id|>\n\n"),
        "user": ("<|start_header_id|>user<|end_header_id|>\n", "<|eot_id|>\n\n"), "assistant": ("<|start_header_id|>assistant<|end_header_id|>", ""),
    },
    "qwen": {"system": ("<|im_start|>system\n", "<|im_end|>\n\n"), "user": ("<|im_start|>user\n", "<|im_end|>\n\n"), "assistant": ("<|im_start|>assistant", "")},
    "mistral": {"system": ("<s>[INST]system\n", "[/INST]\n\n"), "user": ("[INST]user\n", " [/INST]\n\n"), "assistant": ("[INST]assistant\n", "")},
    "chatglm": {"system": ("[Round 1]\n\n问：", "\n\n答："), "user": ("问：", "\n\n答："), "assistant": ("", "\n\n")},
    "baichuan": {
        "system": ("<reserved_106>", "<reserved_107>"), "user": ("<reserved_106>", "<reserved_107>"), "assistant": ("<reserved_108>", "<reserved_108>"),
    },
    "gemma": {"user": ("<start_of_turn>user\n", "<end_of_turn>\n\n"), "assistant": ("<start_of_turn>model", "")},
}
ENTITY, DRUG_A, DRUG_B, UNKNOWN = "[ENTITY]", "[DRUG_A]", "[DRUG_B]", "unknown"
# ---------------------------------------------------------------------------------------------


def method_name(method: str | None) -> str:
    return ALIASES.get(method, method.lower()) if method else "zero_shot"


def method_of(method: Column) -> Column:
    """``method_name`` of a column."""
    out = F.when(F.coalesce(method, F.lit("")) == "", F.lit("zero_shot"))
    for alias, name in ALIASES.items():
        out = out.when(method == alias, F.lit(name))
    return out.otherwise(F.lower(method))


def model_family(name: str | None) -> str:
    """Family for prompts; names of none of the four count as qwen."""
    return next((f for f in FAMILIES if f in (name or "").lower()), "qwen")


def family_of(name: Column) -> Column:
    """``model_family`` of a column; null counts as qwen."""
    low, out = F.lower(F.coalesce(name, F.lit(""))), F.lit("qwen")
    for f in reversed(FAMILIES):
        out = F.when(F.contains(low, F.lit(f)), f).otherwise(out)
    return out


def chat_template(name: str) -> str:
    """Template for direct chat formatting; names of none count as llama."""
    return next((t for word, t in CHAT_NAMES if word in name.lower()), "llama")


def turns(messages: Column, template: str) -> Column:
    """One text from an array of (role, content) in order.  Gemma puts the system text before the
    first user turn; other roles are left out."""
    parts = CHAT[template]
    wrap = lambda role, content: F.concat(F.lit(parts[role][0]), content, F.lit(parts[role][1]))
    if template != "gemma":
        def text(m: Column) -> Column:
            out = F.lit("")
            for role in parts:
                out = F.when(m["role"] == role, wrap(role, m["content"])).otherwise(out)
            return out

        return F.array_join(F.transform(messages, text), "")
    system = F.trim(F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n"))
    talk = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    first = F.array_position(F.transform(talk, lambda m: m["role"]), "user")

    def spoken(m: Column, i: Column) -> Column:
        lead = F.when((i == first - 1) & (system != ""), F.concat(system, F.lit("\n\n"), m["content"])).otherwise(m["content"])
        return F.when(m["role"] == "user", wrap("user", lead)).otherwise(wrap("assistant", m["content"]))

    return F.when((first == 0) & (system != ""), wrap("user", system)).otherwise(F.array_join(F.transform(talk, spoken), ""))


def format_conversations(rows: DataFrame, template: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, text): the turns of each conversation in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.coalesce(text, F.lit("")).alias("content"))))
    return rows.groupBy(conv).agg(ordered.alias("__m")).select(conv, turns(F.col("__m"), template).alias("text"))


def context_sentence(prefix: str, name: Column, ctx: Column, side: str) -> Column:
    """The context lines of one side: ``whose <type> are ...``, or ``whose <typ> is unknown``."""

    def line(x: Column) -> Column:
        value = F.array_join(x[side], ", ")
        single = F.substring(x["type"], F.lit(1), F.length(x["type"]) - 1)
        return F.when(value == UNKNOWN, F.concat(F.lit("whose "), single, F.lit(" is unknown"))).otherwise(F.concat(F.lit("whose "), x["type"], F.lit(" are "), value))

    return F.concat(F.lit(prefix), name, F.lit("\n"), F.array_join(F.transform(ctx, line), "\n"), F.lit("."))


def mask_first(names: Column) -> Column:
    """The first known name becomes the mask."""
    known = F.transform(names, lambda x: (x != UNKNOWN).cast("int"))
    at = F.array_position(known, 1)
    return F.transform(names, lambda x, i: F.when(i == at - 1, F.lit(ENTITY)).otherwise(x))


def mask_entities(ctx: Column, is_a: Column, name: Column) -> Column:
    """Type A: every entry equal to the key name, on both sides.  Else: the first known entry of
    each type and side.  Structure strings stay."""
    equal = lambda names: F.transform(names, lambda x: F.when(x == name, F.lit(ENTITY)).otherwise(x))
    pick = lambda names: F.when(F.coalesce(is_a, F.lit(False)), equal(names)).otherwise(mask_first(names))
    return F.transform(ctx, lambda x: F.struct(
        x["type"].alias("type"), F.when(x["type"] == "smiles", x["A"]).otherwise(pick(x["A"])).alias("A"), F.when(x["type"] == "smiles", x["B"]).otherwise(pick(x["B"])).alias("B"),
    ))


def hide_types(ctx: Column, types: tuple[str, ...] = ("enzymes", "transporters")) -> Column:
    gone = F.array(F.lit(UNKNOWN))
    return F.transform(ctx, lambda x: F.struct(x["type"].alias("type"), F.when(x["type"].isin(*types), gone).otherwise(x["A"]).alias("A"), F.when(x["type"].isin(*types), gone).otherwise(x["B"]).alias("B")))


def _block(a: Column, b: Column) -> Column:
    return F.concat(F.lit("### [Prediction]:\n"), a, F.lit("\n"), b, F.lit("\n### Answer: "))


def pair_block(method: str, name_a: Column, name_b: Column, ctx: Column | None = None, smiles_a: Column | None = None, smiles_b: Column | None = None,
               is_a: Column | None = None, key_name: Column | None = None, desc_a: Column | None = None, desc_b: Column | None = None) -> Column:
    """The prediction block of a method; an unknown method has none."""
    m = method_name(method)
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    if m == "zero_shot":
        return _block(cat("Drug A: ", name_a), cat("Drug B: ", name_b))
    if m == "few_shot_2hop":
        return _block(cat("Query Drug A: ", name_a), cat("Query Drug B: ", name_b))
    if m == "few_shot_similarity_smiles":
        none = lambda s: F.coalesce(s, F.lit("None"))
        return _block(cat("Drug A: ", name_a, ", SMILES: ", none(smiles_a)), cat("Drug B: ", name_b, ", SMILES: ", none(smiles_b)))
    if m == "desc_only":
        return _block(cat("Drug A: ", name_a, "\nClinical description: ", F.trim(desc_a)), cat("Drug B: ", name_b, "\nClinical description: ", F.trim(desc_b)))
    if m == "one_hop_subgraph_single":
        facts = lambda side, name: F.array_join(F.flatten(F.transform(ctx, lambda x: F.transform(x[side], lambda t: cat("(", name, ", has ", x["type"], ", ", t, ")")))), ", ")
        one = lambda s, name: cat(f"Drug {s}: ", name, f"\nDrug {s}'s Facts: ", facts(s, name))
        return _block(one("A", name_a), one("B", name_b))
    if m == "one_hop_subgraph_sequence_desc":
        told = lambda name, d: cat(name, "\nClinical description: ", F.trim(d))
        return _block(context_sentence("Drug A: ", told(name_a, desc_a), ctx, "A"), context_sentence("Drug B: ", told(name_b, desc_b), ctx, "B"))
    if m in SEQUENCE_METHODS:
        names, entities, hidden = SEQUENCE_METHODS[m]
        ctx = mask_entities(ctx, is_a if is_a is not None else F.lit(False), key_name if key_name is not None else F.lit("")) if entities else hide_types(ctx) if hidden else ctx
        a, b = (F.lit(DRUG_A), F.lit(DRUG_B)) if names else (name_a, name_b)
        return _block(context_sentence("Drug A: ", a, ctx, "A"), context_sentence("Drug B: ", b, ctx, "B"))
    return F.lit("")


def structure_examples(examples: Column) -> Column:
    """Reference block of an array of (name_a, smiles_a, name_b, smiles_b, label) in order."""
    one = lambda e, i: F.concat(
        F.lit("### [Example "), (i + 1).cast("string"), F.lit("]\nDrug A: "), e["name_a"], F.lit(", SMILES: "), e["smiles_a"], F.lit("\nDrug B: "), e["name_b"],
        F.lit(", SMILES: "), e["smiles_b"], F.lit("\n### Answer: "), F.when(e["label"] == "1", "Yes").otherwise("No"), F.lit("\n"),
    )
    body = F.concat(F.lit("### Reference Examples (Structural Analogs):\n\n"), F.array_join(F.transform(examples, one), "\n"), F.lit("\n"))
    return F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, body).otherwise("")


def evidence_path(label: str, ref: Column, shared: Column) -> Column:
    """A path over the first shared entity (name, type), or structural similarity if there is none."""
    e = F.get(shared, F.lit(0))
    via = F.when(F.size(shared) > 0, F.concat(e["type"], F.lit(": "), e["name"])).otherwise("Structural Similarity")
    return F.concat(F.lit(f"({label} -> {{"), via, F.lit("} <- "), ref, F.lit(")"))


def mechanism_examples(examples: Column) -> Column:
    """Reference block of (name_a, name_b, label, qa_ca, qb_cb, qa_cb, qb_ca): straight paths unless
    the crossed ones share more."""

    def one(e: Column, i: Column) -> Column:
        straight = F.size(e["qa_ca"]) + F.size(e["qb_cb"]) >= F.size(e["qa_cb"]) + F.size(e["qb_ca"])
        pa = F.when(straight, evidence_path("Query Drug A", e["name_a"], e["qa_ca"])).otherwise(evidence_path("Query Drug A", e["name_b"], e["qa_cb"]))
        pb = F.when(straight, evidence_path("Query Drug B", e["name_b"], e["qb_cb"])).otherwise(evidence_path("Query Drug B", e["name_a"], e["qb_ca"]))
        return F.concat(
            F.lit("### [Example "), (i + 1).cast("string"), F.lit("]\nDrug A: "), e["name_a"], F.lit("\nDrug B: "), e["name_b"], F.lit("\nMatching Evidence: "), pa, F.lit("; "), pb,
            F.lit("\n### Answer: "), F.when(e["label"] == "1", "Yes").otherwise("No"), F.lit("\n"),
        )

    body = F.concat(F.lit("### Reference Examples (Mechanism-Aware):\n\n"), F.array_join(F.transform(examples, one), "\n"), F.lit("\n"))
    return F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, body).otherwise("")


def prompt(method: str, model: str, block: Column, examples: Column | None = None, answer: Column | None = None) -> Column:
    """The whole chat text: task and instruction, note, examples, constraint, block, answer; a null user or answer text has no turn.

    What ``turns`` gives for these three roles, written out: as they are known, all constants are joined beforehand, and of the
    user's text, trimmed as a whole, only the ends that are columns are trimmed."""
    m, family = method_name(method), model_family(model)
    note, system, blank = NOTES.get(m, KG_NOTE if m in SEQUENCE_METHODS else ""), (TASK + INSTRUCTION).strip(), " \n\t\r"
    asked = CONSTRAINT.rstrip(blank)
    front = F.lit((note + asked).lstrip(blank)) if examples is None else F.ltrim(F.concat(F.lit(note), examples, F.lit(asked)), F.lit(blank))
    end = F.rtrim(block, F.lit(blank))
    rest = F.when(end == "", F.lit("")).otherwise(F.concat(F.lit(CONSTRAINT[len(asked):]), end))
    parts = CHAT[family]
    turn = lambda role, lead, *text: F.coalesce(F.concat(F.lit(parts[role][0] + lead), *text, F.lit(parts[role][1])), F.lit(""))
    user = turn("user", f"{system}\n\n", front, rest) if family == "gemma" else turn("user", "", front, rest)
    first = "" if family == "gemma" else system.join(parts["system"])
    return F.concat(F.lit(first), user, turn("assistant", "", answer if answer is not None else F.lit("")))


def answer_of(label: Column) -> Column:
    return F.concat(F.lit(" "), F.when(label == 1, "Yes").when(label == 0, "No").otherwise(F.coalesce(label.cast("string"), F.lit(""))))


def described_pair(name_a: Column, desc_a: Column, name_b: Column, desc_b: Column) -> Column:
    """The text-classifier prompt of two names with descriptions; names alone if both are blank; null
    for an unknown name."""
    a, b = with_full_stop(F.coalesce(desc_a, F.lit(""))), with_full_stop(F.coalesce(desc_b, F.lit("")))
    query = F.concat(F.lit("In the above context, we can predict that the drug-drug interactions between "), name_a, F.lit(" and "), name_b, F.lit(" is that: "))
    told = F.concat(name_a, F.lit(": "), a, F.lit(" "), name_b, F.lit(": "), b, F.lit(" "), query)
    return F.when(name_a.isNull() | name_b.isNull(), F.lit(None).cast("string")).when((a == "") & (b == ""), F.concat(name_a, F.lit(" "), name_b, F.lit(" "), query)).otherwise(told)
