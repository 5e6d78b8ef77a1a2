"""Chat prompts for labelling texts, and the way back from answers to labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from layerlens.functions.text import WHITESPACE

# The wording of every message. {text} is the text to classify and
# {examples} the worked examples of a task.
MESSAGES = {
    ("Zero-Shot", "system"): (
        "You are an assistant trained to perform strict sentiment and emotion classification. "
        "You MUST only respond with the numeric label corresponding to the classification. "
        "Do not provide any explanations, reasoning, or any text other than the required "
        "numeric value."
    ),
    ("Zero-Shot", "user"): "Classify the sentiment of the following text: '{text}'",
    ("Zero-Shot", "assistant", "binary"): (
        "If the sentiment is positive, respond with '1'. "
        "If the sentiment is negative, respond with '0'. "
        "No other text, explanation, or formatting."
    ),
    ("Zero-Shot", "assistant", "emotion"): (
        "Classify the text into one of the following emotions and respond only with the "
        "corresponding number: "
        "0: Sadness, 1: Joy, 2: Love, 3: Anger, 4: Fear, 5: Surprise. "
        "No explanation or additional text."
    ),
    ("Few-Shot", "system"): (
        "You are an assistant trained for sentiment and emotion analysis. "
        "You MUST only respond with the correct numeric label. "
        "Do not provide explanations or any additional text."
    ),
    ("Few-Shot", "user", "binary"): "{examples}\nClassify the following text sentiment:\n'{text}'",
    ("Few-Shot", "user", "emotion"): "{examples}\nClassify the following text emotion:\n'{text}'",
    ("Few-Shot", "assistant", "binary"): (
        "If the sentiment is positive, respond with '1'. "
        "If the sentiment is negative, respond with '0'. "
        "No other text, explanation, or formatting."
    ),
    ("Few-Shot", "assistant", "emotion"): (
        "Respond only with one of the following numbers: "
        "0: Sadness, 1: Joy, 2: Love, 3: Anger, 4: Fear, 5: Surprise. "
        "No other text, explanation, or formatting."
    ),
    ("CoT", "system"): (
        "You are an assistant specialized in sentiment and emotion analysis. "
        "Think step-by-step through the reasoning process (chain-of-thought) privately, "
        "but provide only the final numeric classification as instructed. "
        "Do not include reasoning steps in the output."
    ),
    ("CoT", "user", "binary"): (
        "Analyze the sentiment of the following text:\n\n'{text}'\n\n"
        "Carefully reason step-by-step to determine the sentiment. "
        "Output only '1' for positive sentiment or '0' for negative sentiment as your final "
        "response."
    ),
    ("CoT", "user", "emotion"): (
        "Analyze the emotion of the following text:\n\n'{text}'\n\n"
        "Carefully reason step-by-step to identify the best-matching emotion. "
        "Output only the corresponding number as your final response:\n"
        "0: Sadness, 1: Joy, 2: Love, 3: Anger, 4: Fear, 5: Surprise."
    ),
    ("CoT", "assistant", "binary"): (
        "I will reason step-by-step internally to determine the sentiment. "
        "However, my final response will be '1' for positive sentiment or '0' for negative "
        "sentiment, with no explanation included in the output."
    ),
    ("CoT", "assistant", "emotion"): (
        "I will reason step-by-step internally to determine the most appropriate emotion. "
        "My final response will be one of the following numbers:\n"
        "0: Sadness, 1: Joy, 2: Love, 3: Anger, 4: Fear, 5: Surprise. "
        "No reasoning will be included in the output."
    ),
}

# Worked examples per task, (text, label).
EXAMPLES = {
    "binary": [
        ("I love this product!", 1),
        ("I am disappointed with the service.", 0),
    ],
    "emotion": [
        ("This is the worst day of my life.", 0),
        ("I feel so joyful and alive!", 1),
        ("I feel so deeply connected and grateful for you in my life.", 2),
        ("I am so angry right now.", 3),
        ("I’m really scared and worried about what might happen next.", 4),
        ("Wow, I didn't expect that at all! This is completely unexpected!", 5),
    ],
}

PROMPT_TYPES = ("Zero-Shot", "Few-Shot", "CoT")
ROLES = ("system", "user", "assistant")
TASKS = tuple(EXAMPLES)


def example_block(task: str) -> str:
    return "Examples:\n" + "".join(f"'{text}' => {label}\n" for text, label in EXAMPLES[task])


def template(prompt_type: str, role: str, task: str) -> str:
    """The wording of one message, examples filled in, {text} still open."""
    wording = MESSAGES.get((prompt_type, role)) or MESSAGES[(prompt_type, role, task)]
    return wording.replace("{examples}", example_block(task))


def _check(prompt_type: str, task: str) -> None:
    if prompt_type not in PROMPT_TYPES:
        raise ValueError(f"Unknown prompt type: {prompt_type}")
    if task not in TASKS:
        raise ValueError(f"Unknown task: {task}")


def _content(wording: str, text: Column) -> Column:
    before, hole, after = wording.partition("{text}")
    return F.concat(F.lit(before), text, F.lit(after)) if hole else F.lit(wording)


def messages(text: Column, prompt_type: str, task: str) -> Column:
    """The chat messages for one text, array<struct<role, content>>."""
    _check(prompt_type, task)
    return F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                _content(template(prompt_type, role, task), text).alias("content"),
            )
            for role in ROLES
        ]
    )


def build(df: DataFrame, prompt_types, task: str) -> DataFrame:
    """Every text with every prompt type: the columns of `df`, prompt_type, messages."""
    prompts = [
        F.struct(F.lit(p).alias("prompt_type"), messages(F.col("text"), p, task).alias("messages"))
        for p in prompt_types
    ]
    return df.select("*", F.explode(F.array(*prompts)).alias("p")).select(*df.columns, "p.*")


def answer_label(answer: Column, task: str) -> Column:
    """The label an answer stands for; -1 for an emotion answer that is not a class."""
    if task == "binary":
        return F.when(F.contains(answer, F.lit("1")), 1).otherwise(0)
    if task != "emotion":
        raise ValueError(f"Unknown task: {task}")
    bare = F.regexp_extract(answer, f"^(?:{WHITESPACE})?([0-5])(?:{WHITESPACE})?\\z", 1)
    return F.when(bare != "", bare.try_cast("int")).otherwise(-1)
