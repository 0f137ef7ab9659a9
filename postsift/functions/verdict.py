"""Verdicts, reasons and how they are shown."""

from pyspark.sql import Column, functions as F

from postsift import vocab
from postsift.functions.text import _col

FRAUD = "fraudulent"
LEGITIMATE = "legitimate"

REASON_TYPE = "array<struct<feature:string,description:string,shap_value:double,impact:string>>"


def stub_label(free_email_flag, urgency_term_count) -> Column:
    """Rule used while there is no model: free mail and urgency together."""
    both = _col(free_email_flag) & (_col(urgency_term_count) > 0)
    return F.when(both, F.lit(FRAUD)).otherwise(F.lit(LEGITIMATE))


def stub_classify(df):
    return df.withColumns({
        "label": stub_label("free_email_flag", "urgency_term_count"),
        "confidence_score": F.lit(0.5),
        "is_stub": F.lit(True),
    })


def describe(feature) -> Column:
    """Plain-language description of a feature name."""
    table = F.create_map(*[F.lit(x) for pair in vocab.FEATURE_DESCRIPTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, _col(feature)), _col(feature))


def _stub_reason(feature, impact) -> Column:
    return F.struct(
        F.lit(feature).alias("feature"),
        F.lit(vocab.FEATURE_DESCRIPTIONS[feature]).alias("description"),
        F.lit(None).cast("double").alias("shap_value"),
        F.lit(impact).alias("impact"),
    )


def stub_reasons(free_email_flag, urgency_term_count, ttr) -> Column:
    """Reasons in fixed order, with the wording reason when none applies."""
    free, urgent = _col(free_email_flag), _col(urgency_term_count) > 0
    repetitive = (_col(ttr) < 0.4) | ~(free | urgent)
    named = F.array(
        F.when(free, _stub_reason("free_email_flag", "high")),
        F.when(urgent, _stub_reason("urgency_term_count", "moderate")),
        F.when(repetitive, _stub_reason("ttr", "moderate")),
    )
    return F.array_compact(named).cast(REASON_TYPE)


def summary_text(reasons, label) -> Column:
    listed = F.array_join(F.transform(_col(reasons), lambda r: r["description"]), "; ")
    flagged = F.concat(F.lit("Flagged as likely fraudulent due to: "), listed, F.lit("."))
    cleared = F.concat(F.lit("Classified as legitimate. Noted characteristics: "), listed, F.lit("."))
    return F.when(_col(label) == FRAUD, flagged).otherwise(cleared)


def confidence_pct(score) -> Column:
    """Whole percent, halves rounded up."""
    return F.floor(_col(score) * 100 + 0.5)


def verdict_text(label) -> Column:
    label = _col(label)
    return (
        F.when(label.isNull() | (label == ""), F.lit("Pending"))
        .when(label == FRAUD, F.lit("Fraudulent"))
        .otherwise(F.lit("Legitimate"))
    )


def result_headline(label) -> Column:
    return F.when(_col(label) == FRAUD, F.lit("Likely fraudulent")).otherwise(F.lit("Likely legitimate"))


def result_message(label, summary) -> Column:
    """The sentence under a headline: the explanation of a fraud, else a fixed line."""
    scam = F.coalesce(_col(summary), F.lit("This posting shows patterns common in recruitment scams."))
    clean = F.lit("We didn't find the writing patterns typically seen in scam postings.")
    return F.when(_col(label) == FRAUD, scam).otherwise(clean)
