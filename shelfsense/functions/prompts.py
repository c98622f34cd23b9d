"""Prompt texts and chat messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfsense.functions.text import strip

# The prompt and judge wordings, which downstream models were tuned on.
SUMMARY_HEAD = "Summarize the main {sentiment} customer feedback for this product."
SUMMARY_RULES = (
    "Requirements:\n"
    "- Mention only recurring themes supported by the reviews.\n"
    "- Do not invent details.\n"
    "- Prefer concrete themes over generic praise/complaints.\n"
    "- Write one concise summary in 1-3 sentences."
)
NO_REVIEWS = "1. No reviews available."
UNKNOWN_PRODUCT = "Unknown product"
UNKNOWN_CATEGORY = "Unknown category"
PLACEHOLDER = "Placeholder {sentiment} summary generated from {count} representative reviews."
MOCK = (
    "Mock {sentiment} summary generated from {count} representative reviews. "
    "This is used for CI and local tests."
)
JUDGE_HEAD = """You are evaluating a product review summary.

The original task prompt already contains:
- the target sentiment bucket
- product information
- the source customer reviews
- the summarization instructions

Your job is to evaluate the generated summary against the task prompt and the source reviews inside it.

Task prompt:
"""
JUDGE_RULES = """Score the generated summary from 1 to 5 on these criteria:

1. faithfulness
- Are all claims supported by the source reviews?
- Penalize unsupported or invented claims heavily.

2. coverage
- Does the summary capture the main recurring points in the reviews?
- Missing minor details is acceptable, but missing major repeated themes should lower the score.

3. sentiment_alignment
- Does the summary match the intended sentiment bucket in the task prompt?
- For example, a negative summary should focus on complaints, not praise.

4. clarity
- Is the summary concise, readable, and non-redundant?

Scoring rubric:
- 5 = excellent, no meaningful issues
- 4 = good, only minor issues
- 3 = acceptable, but noticeable issues
- 2 = poor, major issues
- 1 = very poor or unusable

Important rules:
- Judge based mainly on the source reviews in the task prompt.
- Do not require any specific wording.
- Reward semantic correctness over surface similarity.
- Hallucinations should strongly reduce faithfulness and overall score.
- Overall score should reflect practical usefulness, with faithfulness weighted most heavily.

Return ONLY valid JSON in this exact format:
{
  "faithfulness": 1,
  "coverage": 1,
  "sentiment_alignment": 1,
  "clarity": 1,
  "overall": 1.0
}"""


def numbered(texts: Column) -> Column:
    lines = F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t))
    return F.array_join(lines, "\n")


def _prompt(title: Column, category: Column, sentiment: Column, block: Column) -> Column:
    before, after = SUMMARY_HEAD.split("{sentiment}")
    return strip(
        F.concat(
            F.lit(before), sentiment, F.lit(after + "\n\nProduct title: "), title, F.lit("\nCategory: "), category,
            F.lit("\n\nReviews:\n"), block, F.lit("\n\n" + SUMMARY_RULES),
        )
    )


def dataset_prompt(title: Column, category: Column, sentiment: Column, reviews: Column) -> Column:
    """Prompt of the summary dataset; blank or missing product fields get a stand-in."""
    return _prompt(
        F.coalesce(F.nullif(title, F.lit("")), F.lit(UNKNOWN_PRODUCT)),
        F.coalesce(F.nullif(category, F.lit("")), F.lit(UNKNOWN_CATEGORY)),
        sentiment,
        numbered(reviews),
    )


def insight_prompt(title: Column, category: Column, sentiment: Column, reviews: Column) -> Column:
    """Prompt of an insight; an empty review list still gives a numbered line."""
    block = F.when(F.size(reviews) > 0, numbered(F.transform(reviews, strip))).otherwise(F.lit(NO_REVIEWS))
    empty = F.lit("")
    return _prompt(F.coalesce(title, empty), F.coalesce(category, empty), F.lower(strip(sentiment)), block)


def placeholder_summary(prompt: Column, sentiment: Column, count: Column, template: str = PLACEHOLDER) -> Column:
    """Stand-in text of the default generator; ``MOCK`` gives the test generator's text."""
    before, rest = template.split("{sentiment}")
    middle, after = rest.split("{count}")
    return F.concat(F.lit(before), sentiment, F.lit(middle), count.cast("string"), F.lit(after))


def judge_prompt(prompt: Column, prediction: Column) -> Column:
    return strip(
        F.concat(F.lit(JUDGE_HEAD), prompt, F.lit("\n\nGenerated summary:\n"), prediction, F.lit("\n\n" + JUDGE_RULES))
    )


def to_messages(prompt: Column, answer: Column) -> Column:
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), strip(content).alias("content"))

    return F.array(turn("user", prompt), turn("assistant", answer))


def last_of_role(messages: Column, role: str) -> Column:
    """Trimmed content of the last message of a role, NULL when there is none."""
    spoken = F.filter(messages, lambda m: m["role"] == role)
    return strip(F.try_element_at(spoken, F.lit(-1))["content"])


def messages_valid(messages: Column) -> Column:
    """At least two messages, each with a role and a content that is not blank."""
    def whole(m: Column) -> Column:
        return F.coalesce(m["role"].isNotNull() & (strip(m["content"]) != ""), F.lit(False))

    return F.coalesce((F.size(messages) >= 2) & F.forall(messages, whole), F.lit(False))
