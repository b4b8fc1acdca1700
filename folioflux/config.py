"""All tunables in one place, and the catalogs of models and prompts."""

from __future__ import annotations

from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Settings:
    """The defaults that results depend on."""

    # chunking, in words
    target_words: int = 300
    min_words: int = 150
    max_words: int = 400
    max_table_words: int = 450
    overlap_words: int = 26
    min_line_chars: int = 2
    first_page_chars: int = 2000
    # ranking
    same_document: float = 1.5
    same_number: float = 1.4
    same_range: float = 1.35
    same_subgroup: float = 1.3
    same_major: float = 1.2
    adjacent: float = 1.3
    near: float = 1.15
    nearby: float = 1.05
    # second-stage scoring
    rerank_top: int = 20
    final_top: int = 10
    pair_tokens: int = 512
    blank_score: float = -10.0
    # retrieval and answers
    search_k: int = 5
    retrieve_k: int = 3
    query_k: int = 50
    prompt_reserve: int = 64
    excerpt_chars: int = 200
    preview_chars: int = 500
    max_question_chars: int = 1000
    # writing
    file_batch: int = 8
    vector_batch: int = 1000

    def checked(self) -> Settings:
        if not self.min_words <= self.target_words <= self.max_words:
            raise ValueError("chunk sizes must satisfy min_words <= target_words <= max_words")
        return self

    def with_(self, **changes: object) -> Settings:
        return replace(self, **changes).checked()


DEFAULT = Settings()

#: Answer models (name, tier, max_tokens, temperature, top_p, prompt_style, context_window).
LLM_MODELS = [
    ("tinyllama:1.1b-chat-v1-q4_K_M", 0, 256, 0.7, 0.9, "simple", 2048),
    ("llama3.2:1b-instruct-q4_K_M", 1, 400, 0.7, 0.9, "instruct", 4096),
    ("llama3.2:3b-instruct-q4_K_M", 2, 512, 0.5, 0.95, "instruct", 4096),
    ("gemma2:9b-instruct-q4_K_M", 3, 1024, 0.6, 0.9, "instruct", 8192),
    ("phi4-mini:latest", 4, 1024, 0.6, 0.9, "instruct", 8192),
]
#: What an unknown model gets (tier, max_tokens, temperature, top_p, prompt_style, context_window).
UNKNOWN_MODEL = (None, 256, 0.7, 0.95, "fallback", 2048)
#: Memory in GB from which a tier is used.
TIER_FROM_GB = [(0, 0.0), (1, 4.0), (2, 6.0), (3, 8.0), (4, 12.0)]
#: Embedding models (name, from GB of memory).
EMBEDDING_FROM_GB = [("all-MiniLM-L6-v2", 0.0), ("all-mpnet-base-v2", 8.0), ("mixedbread-ai/mxbai-embed-large-v1", 16.0)]

#: Prompt templates by style; {context} and {question} are filled in. `fallback` serves unknown styles.
PROMPTS = {
    "simple": """Context from DOD policies:
{context}

Question: {question}

Instructions: Answer based ONLY on the context above. If the context doesn't contain enough information to answer the question, say "The provided policies do not contain sufficient information to answer this question."

Answer:
""",
    "instruct": """### System:
You are an expert assistant for Department of Defense policy questions. You must answer based ONLY on the provided context. Do not use any external knowledge or make assumptions beyond what is explicitly stated in the context.

### Context:
{context}

### Question: {question}

### Instructions:
- Answer using ONLY information found in the context above
- If the context doesn't contain enough information, respond with "The provided policies do not contain sufficient information to answer this question"
- Quote relevant parts of the policies when possible
- Do not add information not present in the context

### Answer:
""",
    "mistral": """[INST] You are a helpful assistant that answers questions about Department of Defense policies based ONLY on provided excerpts.

IMPORTANT RULES:
- Use ONLY the information provided in the context below
- Do not use external knowledge or make assumptions
- If the context doesn't contain enough information, say "The provided policies do not contain sufficient information to answer this question"
- Quote specific policy sections when relevant

Context from DOD policies:
{context}

Question: {question} [/INST]
""",
    "fallback": """Context from DOD policies:
{context}

Question: {question}

Instructions: Answer based ONLY on the context above. If the context doesn't contain enough information, say "The provided policies do not contain sufficient information to answer this question."

Answer:""",
}


def llm_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LLM_MODELS, "model string, tier int, max_tokens int, temperature double, top_p double, prompt_style string, context_window int")


def prompts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(PROMPTS.items()), "style string, template string")


def tiers(spark: SparkSession) -> DataFrame:
    bounds = [x for _, x in TIER_FROM_GB[1:]] + [float("inf")]
    return spark.createDataFrame([(t, lo, hi) for (t, lo), hi in zip(TIER_FROM_GB, bounds)], "tier int, from_gb double, to_gb double")


def embedding_models(spark: SparkSession) -> DataFrame:
    bounds = [x for _, x in EMBEDDING_FROM_GB[1:]] + [float("inf")]
    return spark.createDataFrame([(m, lo, hi) for (m, lo), hi in zip(EMBEDDING_FROM_GB, bounds)], "model string, from_gb double, to_gb double")


def lookup(tree: dict, path: str, default: object = None) -> object:
    """The value at a dotted path of a nested map; the default where there is none, or an empty map."""
    value: object = tree
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return default if value is None or value == {} else value


def machine() -> dict[str, object]:
    """The driver's memory in GB and processors, and the models that they allow."""
    import os

    gb = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30
    tier = max(t for t, least in TIER_FROM_GB if gb >= least)
    model = next(m[0] for m in reversed(LLM_MODELS) if m[1] <= tier)
    embedding = [name for name, least in EMBEDDING_FROM_GB if gb >= least][-1]
    return {"ram_gb": round(gb, 1), "cpu_cores": os.cpu_count(), "recommended_model": model, "recommended_embedding": embedding}


def _scalar(text: str) -> object:
    text = text.strip()
    if text[:1] in "\"'" and text[:1]:
        return text[1 : text.index(text[0], 1)]
    text = text.split(" #")[0].strip()
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "~": None}.get(text.lower(), text)


def read(path: str | Path) -> dict:
    """A configuration file: nested maps by indentation, scalars, and literal blocks (|). Not all of YAML: no lists."""
    lines = Path(path).read_text().splitlines()
    root: dict = {}
    open_: list[tuple[int, dict]] = [(-1, root)]
    k = 0
    while k < len(lines):
        line, bare = lines[k], lines[k].strip()
        k += 1
        if not bare or bare.startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        while open_[-1][0] >= depth:
            open_.pop()
        name, _, value = bare.partition(":")
        value = value.strip()
        if value == "|":
            block = []
            while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip()) > depth):
                block.append(lines[k])
                k += 1
            inner = min((len(x) - len(x.lstrip()) for x in block if x.strip()), default=0)
            open_[-1][1][name.strip("\"'")] = "\n".join(x[inner:] for x in block).rstrip("\n ") + "\n"
        elif not value or value.startswith("#"):
            below: dict = {}
            open_[-1][1][name.strip("\"'")] = below
            open_.append((depth, below))
        else:
            open_[-1][1][name.strip("\"'")] = _scalar(value)
    return root


def load(path: str | Path) -> Settings:
    """Settings from a file of names and values, in sections or not; unknown names are an error, absent ones keep the default."""
    changes: dict[str, object] = {}

    def take(tree: dict) -> None:
        for name, value in tree.items():
            if isinstance(value, dict):
                take(value)
            elif name not in Settings.__dataclass_fields__:
                raise ValueError(f"unknown setting {name!r}")
            else:
                changes[name] = type(getattr(DEFAULT, name))(value)

    take(read(path))
    return DEFAULT.with_(**changes)
