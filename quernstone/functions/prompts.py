"""Prompts and chat messages as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

MODES = {
    "free": ("", ""),
    "optimistic": ("Assume that callers keep every contract that the code does not check.", "Remember to trust callers."),
    "pessimistic": ("Assume that every input may be hostile.", "Remember to distrust callers."),
}
SYSTEM = "You review C functions for weaknesses.{assumptions}{guidance}"
ASSESSMENT = "Structured Assessment"
USER = "Review this function:\n{func}{reminder}"

DELIMITERS = (
    ("### instruction", tuple(f"### {r}:" for r in ("Instruction", "Response"))),
    ("[inst]", ("[INST]", "[/INST]")),
    ("start_header_id", tuple(f"<|start_header_id|>{r}<|end_header_id|>" for r in ("user", "assistant"))),
    ("im_start", tuple(f"<|im_start|>{r}" for r in ("user", "assistant"))),
    ("<|user|>", tuple(f"<|{r}|>" for r in ("user", "assistant"))),
    ("start_of_turn", tuple(f"<start_of_turn>{r}" for r in ("user", "model"))),
)


def assumption(mode: str, phase: str = "training") -> tuple[str, str]:
    """(assumptions, reminder) of a mode; only phases other than training are reminded."""
    text, reminder = MODES[mode]
    return text, reminder if phase != "training" else ""


def system_prompt(mode: str = "free", guidance: str = "", phase: str = "training", template: str = SYSTEM) -> str:
    """Rendered once on the driver: it is the same for all rows."""
    text, _ = assumption(mode, phase)
    return template.format(assumptions=f"\n{text}" if text else "", guidance=f"\n{guidance}" if guidance else "")


def user_prompt(func: Column, mode: str = "free", phase: str = "training", template: str = USER) -> Column:
    _, reminder = assumption(mode, phase)
    before, after = template.format(func="\0", reminder=f"\n{reminder}" if reminder else "").split("\0")
    return F.concat(F.lit(before), F.coalesce(func, F.lit("")), F.lit(after))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def as_messages(func: Column, answer: Column | None = None, mode: str = "free", guidance: str = "", phase: str = "training") -> Column:
    """System and user messages, and the assistant's where there is an answer in training."""
    parts = [message("system", F.lit(system_prompt(mode, guidance, phase))), message("user", user_prompt(func, mode, phase))]
    if answer is not None and phase == "training":
        parts.append(F.when(answer.isNotNull(), message("assistant", answer)))
    return F.array_compact(F.array(*parts))


def bullets(labels: Column, texts: Column, strict: bool = False) -> Column:
    """Lines "- label: text"; the longer list is cut, or with strict raises an error."""
    size = F.least(F.size(labels), F.size(texts))
    pairs = F.arrays_zip(F.slice(labels, F.lit(1), size).alias("l"), F.slice(texts, F.lit(1), size).alias("t"))
    lines = F.array_join(F.transform(pairs, lambda x: F.concat(F.lit("- "), x["l"], F.lit(": "), x["t"])), "\n")
    return F.when(F.size(labels) != F.size(texts), F.raise_error(F.lit("labels and texts differ in number"))).otherwise(lines) if strict else lines


def known_outcome(target: Column, labels: Column, texts: Column | None = None) -> Column:
    """What is known of a sample, in words."""
    listed = bullets(labels, texts, strict=True) if texts is not None else F.array_join(F.transform(labels, lambda x: F.concat(F.lit("- "), x)), "\n")
    named = F.concat(F.lit("The function is VULNERABLE. Its weaknesses:\n"), listed)
    return F.when(target != 1, F.lit("The function is SAFE.")).when(F.size(labels) > 0, named).otherwise(F.lit("The function is VULNERABLE. Its weaknesses are not given."))


def judge_info(target: Column, labels: Column, texts: Column) -> Column:
    return F.when(target == 1, bullets(labels, texts)).otherwise(F.lit("None"))


def judge_prompt(fields: Mapping[str, Column]) -> Column:
    """Titled sections of a judge's prompt in the order given."""
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"## {k}\n"), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()))


def assessment(target: Column, labels: Column, texts: Column) -> Column:
    """Structured answer: vulnerabilities and verdict as a struct."""
    ids = F.transform(labels, lambda x: F.replace(x, F.lit("CWE-"), F.lit("")).try_cast("int"))
    found = F.transform(F.arrays_zip(ids.alias("i"), texts.alias("t")), lambda z: F.struct(z["i"].alias("cwe_id"), z["t"].alias("description")))
    return F.struct(found.alias("vulnerabilities"), F.struct((target == 1).alias("is_vulnerable"), ids.alias("cwe_list")).alias("verdict"))


def with_assessment(reasoning: Column, target: Column, labels: Column, texts: Column) -> Column:
    """Reasoning followed by its structured assessment as fenced JSON."""
    return F.concat(F.trim(reasoning), F.lit(f"\n\n**{ASSESSMENT}:**\n```json\n"), F.to_json(assessment(target, labels, texts)), F.lit("\n```"))


def chat_text(messages: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """Messages as one text in the ChatML form."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(start), m["role"], F.lit("\n"), m["content"], F.lit(f"{end}\n"))), "")


def delimiters(model: str, template: str = "") -> tuple[str, str]:
    """Where user and assistant turns begin, by model name or chat template."""
    name, low = model.lower(), template.lower()
    if "deepseek" in name:
        return DELIMITERS[0][1]
    if "codellama" in name:
        return DELIMITERS[1][1]
    for mark, pair in DELIMITERS:
        if mark in low:
            return pair
    raise ValueError(f"no known chat format for {model}")


def batch_request(key: Column, messages: Column, model: str, most_tokens: int = 2048, temperature: float = 0.2, url: str = "/chat/completions") -> Column:
    """One request line as JSON."""
    body = F.struct(F.lit(model).alias("model"), F.lit(most_tokens).alias("max_completion_tokens"), messages.alias("messages"), F.lit(temperature).alias("temperature"))
    return F.to_json(F.struct(key.cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body")))


def registered(names: Sequence[str], make: Mapping[str, object]) -> dict[str, object]:
    """The named entries of a registry; an unknown name raises."""
    unknown = [n for n in names if n not in make]
    if unknown:
        raise KeyError(f"not registered: {unknown}")
    return {n: make[n] for n in names}
