"""Triage prompts, provider choice, reply validation and the severity gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake import schemas
from revlake.functions.strict_json import is_typed_object
from revlake.functions.text import blank_to_null, pin
from revlake.languages import LANGUAGES

# The reply's enumerations and the severities worth posting.
SEVERITIES = ("critical", "high", "medium", "none")
ISSUE_TYPES = ("security", "crash", "data_loss", "concurrency", "correctness", "none")
POSTED_SEVERITIES = ("critical", "high")

# The wording is a parameter; a site passes its own with the same four marks.
PROMPT_TEMPLATE = """You triage a pull request for production risk only.

Answer severity=none for style, complexity or readability concerns, and
whenever you are not sure that there is a real defect.
Answer severity=high or severity=critical only for a security hole, a crash on
realistic input, lost or corrupted data, a concurrency defect, or code whose
result is wrong in production.

The complexity score ({score}) only selected this function for review and is
no reason to flag it.

The {language} function `{name}`:

```{fence}
{source}
```
"""


@dataclass(frozen=True)
class Provider:
    default_model: str
    needs_key: bool = False


# Known providers and the model each uses when none is named.
PROVIDERS = {
    schemas.PROVIDER_DEFAULT: Provider(schemas.MODEL_DEFAULT, needs_key=True),
    "openai": Provider("gpt-4o"),
    "ollama": Provider("codellama"),
}


def _lookup(key: Column, entries: dict[str, str]) -> Column:
    choice = None
    for name, value in entries.items():
        choice = F.when(key == name, value) if choice is None else choice.when(key == name, value)
    return choice


def fence_of(language: Column) -> Column:
    """Code-fence tag: the registered language, or the given name itself."""
    return F.coalesce(_lookup(language, {s.language: s.language for s in LANGUAGES}), language)


def prompt_of(
    name: Column, score: Column, language: Column, source: Column, template: str = PROMPT_TEMPLATE
) -> Column:
    """Fill a template's {score}, {language}, {name}, {fence} and {source} marks."""
    marks = {
        "score": score.cast("string"), "language": language, "name": name,
        "fence": fence_of(language), "source": source,
    }
    pieces: list[Column] = []
    rest = template
    while rest:
        places = [(rest.find("{" + mark + "}"), mark) for mark in marks]
        places = [p for p in places if p[0] >= 0]
        if not places:
            pieces.append(F.lit(rest))
            break
        at, mark = min(places)
        pieces += [F.lit(rest[:at]), marks[mark]]
        rest = rest[at + len(mark) + 2 :]
    return F.concat(*pieces)


def with_prompts(flagged: DataFrame, template: str = PROMPT_TEMPLATE) -> DataFrame:
    return flagged.withColumn(
        "prompt",
        prompt_of(F.col("result_name"), F.col("score"), F.col("language"), F.col("source_code"), template),
    )


def resolve_provider(
    requests: DataFrame,
    default_provider: str = schemas.PROVIDER_DEFAULT,
    providers: dict[str, Provider] = PROVIDERS,
    keys_present: frozenset[str] = frozenset(PROVIDERS),
) -> DataFrame:
    """Add provider, model and error from llm_provider and llm_model.

    Empty values fall back: the provider to the site default, the model to the
    provider's own. A row with an error must not be sent.
    """
    provider = F.coalesce(blank_to_null(F.col("llm_provider")), F.lit(default_provider))
    default_model = _lookup(provider, {n: p.default_model for n, p in providers.items()})
    keyless = [n for n, p in providers.items() if p.needs_key and n not in keys_present]
    error = F.when(~provider.isin(list(providers)), F.concat(F.lit("Unknown LLM provider: "), provider))
    if keyless:
        error = error.when(provider.isin(keyless), F.concat(F.lit("No API key for provider: "), provider))
    return requests.select(
        "*",
        provider.alias("provider"),
        F.when(error.isNull(), F.coalesce(blank_to_null(F.col("llm_model")), default_model)).alias("model"),
        error.alias("provider_error"),
    )


def parsed_reply(response_json: Column) -> Column:
    """Fields of a reply; null unless the whole text is one JSON object whose fields are strings or null."""
    return F.when(is_typed_object(response_json, schemas.TRIAGE_REPLY.names), F.from_json(response_json, schemas.TRIAGE_REPLY))


def latest_replies(responses: DataFrame) -> DataFrame:
    """One reply per result: the last by ``reply_seq`` where the table has it, ties by the text."""
    order = [c for c in ("reply_seq",) if c in responses.columns]
    last = F.max(F.struct(*order, "response_json"))["response_json"]
    return responses.groupBy("function_id", "result_name").agg(last.alias("response_json"))


def validate_replies(responses: DataFrame) -> DataFrame:
    """Open replies and mark whether they meet the reply schema."""
    opened = pin(responses, _reply=parsed_reply(F.col("response_json")))
    reply = F.col("_reply")
    complete = (
        reply["severity"].isin(*SEVERITIES)
        & reply["issue_type"].isin(*ISSUE_TYPES)
        & reply["summary"].isNotNull()
        & reply["explanation"].isNotNull()
    )
    kept = [c for c in responses.columns if c != "response_json"]
    return opened.select(
        *kept,
        *[reply[f].alias(f) for f in schemas.TRIAGE_REPLY.names],
        F.coalesce(complete, F.lit(False)).alias("is_valid"),
    )


def severity_gate(replies: DataFrame) -> DataFrame:
    return replies.filter(F.col("severity").isin(*POSTED_SEVERITIES))
