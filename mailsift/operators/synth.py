"""Synthetic legitimate e-mails (G1–G3) and the prompt grid.

G1 fills a message template from fixed pools; every choice is an md5 draw of
``(stage, row id, field)``, so generation is a pure column expression over any id column —
it parallelises like a projection and is identical on every run and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import draw_range, pick
from ..functions.text import fill_template, fingerprint
from .compute import with_computed
from .dedup import dedup_keep_first

# ---------------------------------------------------------------------------------------
# FIXED VALUES: template pools of the legitimate-mail generator (in their original order).
# ---------------------------------------------------------------------------------------
TEMPLATES = (
    "Subject: {subject}\n\nHi {name},\n\n{body}\n\nBest regards,\n{sender}",
    "Subject: {subject}\n\nDear {name},\n\n{body}\n\nThanks,\n{sender}",
    "Subject: {subject}\n\nTeam,\n\n{body}\n\nBest,\n{sender}",
    "Subject: {subject}\n\n{body}\n\nTo unsubscribe, click here: [URL]\n\n{company}",
    "Subject: {subject}\n\n{body}\n\nThis is an automated message from {company}.",
    "Subject: {subject}\n\nHey {name}!\n\n{body}\n\nCheers,\n{sender}",
)
SUBJECTS = (
    "Meeting tomorrow at {time}", "Team sync - {day}", "Quick catch up?",
    "Reschedule our call", "Conference room booking", "Agenda for Monday",
    "Project update", "Q{quarter} report review", "Weekly status",
    "Document for your review", "Feedback needed", "Quick question",
    "Re: Your proposal", "Follow up on our discussion", "Action items from today",
    "Your weekly digest", "{month} newsletter", "What's new this week",
    "Industry news roundup", "Tips and updates", "New features available",
    "Your order has shipped", "Order confirmation #{number}",
    "Your receipt from {store}", "Delivery update", "Thank you for your purchase",
    "Photos from {event}", "Happy birthday!", "Thanks for last night",
    "See you Saturday?", "Dinner plans", "Weekend plans?",
    "Your appointment confirmation", "Reminder: {event} tomorrow",
    "Your monthly statement is ready", "Account summary for {month}",
    "Your subscription has been renewed",
)
BODIES = (
    "Just wanted to confirm our meeting for {day}. Please let me know if the time still works for you.",
    "Can we reschedule our call to {time}? Something came up on my end.",
    "Here's the agenda for our upcoming meeting:\n1. Project updates\n2. Budget review\n3. Next steps",
    "I've attached the document you requested. Please review and let me know if you have any questions.",
    "The project is progressing well. We're on track to deliver by {date}.",
    "Thanks for your feedback on the proposal. I've incorporated your suggestions.",
    "Could you please review the attached and share your thoughts by end of day?",
    "Here are the action items from our meeting today:\n- Item 1\n- Item 2\n- Item 3",
    "Your order #{number} has been shipped. You can track it using the link below.",
    "Thank you for your purchase! Your order will arrive by {date}.",
    "Your payment of ${amount} has been processed successfully.",
    "This is a reminder that your appointment is scheduled for {date} at {time}.",
    "Your monthly statement for {month} is now available in your account.",
    "Your subscription has been renewed. Next billing date: {date}.",
    "It was great catching up yesterday! Let's do it again soon.",
    "Are you free this weekend? Thought we could grab coffee.",
    "Here are the photos from the {event}. Hope you enjoy them!",
)
NAMES = ("John", "Sarah", "Michael", "Emily", "David", "Lisa", "James", "Anna", "Robert", "Maria")
COMPANIES = ("Acme Corp", "Tech Solutions", "Digital Services", "Cloud Systems", "Data Pro")
STORES = ("Amazon", "Target", "Best Buy", "Walmart", "Apple Store")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")
MONTHS = ("January", "February", "March", "April", "May", "June")
QUARTERS = ("1", "2", "3", "4")
DATE_DAYS = ("Monday", "Tuesday", "Wednesday")
DATE_MONTHS = ("Jan", "Feb", "Mar")
EVENTS = ("the conference", "last weekend", "the party", "our trip")
# placeholder order of the fill (subject and body first among the nested templates)
KEY_ORDER = ("subject", "name", "sender", "company", "store", "body", "time", "day", "month",
             "quarter", "date", "number", "amount", "event")

SYNTH_STAGE = "synth"


def draws(id_col: str, stage: str = SYNTH_STAGE) -> dict[str, Column]:
    """The placeholder values of G1 for a row, as columns."""
    def p(values, field):
        return pick(values, stage, id_col, field)

    def r(lo, hi, field):
        return draw_range(lo, hi, stage, id_col, field)

    return {
        "subject": p(SUBJECTS, "subject"), "name": p(NAMES, "name"), "sender": p(NAMES, "sender"),
        "company": p(COMPANIES, "company"), "store": p(STORES, "store"), "body": p(BODIES, "body"),
        "time": F.concat(r(9, 17, "time").cast("string"), F.lit(":00")),
        "day": p(DAYS, "day"), "month": p(MONTHS, "month"), "quarter": p(QUARTERS, "quarter"),
        "date": F.concat(p(DATE_DAYS, "date_day"), F.lit(", "), r(1, 28, "date_num").cast("string"),
                         F.lit(" "), p(DATE_MONTHS, "date_month")),
        "number": r(100000, 999999, "number").cast("string"),
        "amount": F.concat(r(10, 500, "amount").cast("string"), F.lit("."),
                           F.lpad(r(0, 99, "cents").cast("string"), 2, "0")),
        "event": p(EVENTS, "event"),
    }


def generate(df: DataFrame, id_col: str, out: str = "email_text", stage: str = SYNTH_STAGE) -> DataFrame:
    """G1: one synthetic legitimate e-mail per row of ``df`` (seeded by ``id_col``)."""
    d = draws(id_col, stage)
    values = {f"_v_{k}": d[k] for k in KEY_ORDER}
    tmpl = pick(TEMPLATES, stage, id_col, "template")
    staged = with_computed(df, _tmpl=tmpl, **values)
    filled = fill_template(F.col("_tmpl"), [(k, F.col(f"_v_{k}")) for k in KEY_ORDER])
    return staged.withColumn(out, filled).drop("_tmpl", *values.keys())


#: Candidates per seed row beyond which no more are drawn.
MAX_PER_SEED = 1024


def generate_distinct(seeds: DataFrame, id_col: str, n: int, per_seed: int = 2,
                      stage: str = SYNTH_STAGE) -> DataFrame:
    """``n`` synthetic e-mails with distinct fingerprints.

    Each seed row yields ``per_seed`` candidates (``cand_id = id * per_seed + k``);
    duplicates by fingerprint keep the lowest candidate id; the first ``n`` survivors in
    the ``synthpick`` hash order are returned. While fewer than ``n`` survive, the candidates
    are drawn anew with twice as many per seed; with ``MAX_PER_SEED`` the job fails.
    """
    from ..functions.hashing import hash_key
    from ..session import materialize
    from .ranking import first_n
    while True:
        cands = seeds.select((F.col(id_col) * per_seed).alias("_base"),
                             F.explode(F.sequence(F.lit(0), F.lit(per_seed - 1))).alias("_k")) \
            .select((F.col("_base") + F.col("_k")).alias("cand_id"))
        texts = generate(cands, "cand_id", "email_text", stage).withColumn("fp", fingerprint("email_text"))
        uniq = materialize(dedup_keep_first(texts, "fp", "cand_id"))
        got = uniq.count()
        if got >= n:
            break
        if per_seed >= MAX_PER_SEED:
            raise RuntimeError(f"only {got} distinct e-mails could be generated, {n} requested")
        per_seed *= 2
    picked = first_n(uniq.withColumn("_k", hash_key("synthpick", "cand_id")), "_k", "cand_id", n)
    return picked.drop("_k")


def check_count(df: DataFrame, n: int, what: str = "rows") -> DataFrame:
    """Fail the job (not silently return fewer rows) when ``df`` has fewer than ``n`` rows."""
    got = df.count()
    if got < n:
        raise RuntimeError(f"only {got} distinct {what} could be generated, {n} requested")
    return df


# FIXED VALUES: prompt-grid dimensions of the generation audit.
ARCHETYPES = tuple(f"archetype_{i:02d}" for i in range(1, 19))
TONES = ("formal", "neutral", "urgent")
URGENCY = ("low", "medium", "high")
LINKS = ("none", "one", "several")
ATTACHMENT = ("no", "yes")
LANGUAGES = ("es", "en")


def prompt_grid(spark: SparkSession) -> DataFrame:
    """Every combination of the six prompt dimensions (18·3·3·3·2·2 = 1,944 rows),
    generated by explode of literal arrays — no join."""
    df = spark.range(1).select()
    for name, values in (("archetype", ARCHETYPES), ("tone", TONES), ("urgency", URGENCY),
                         ("links", LINKS), ("attachment", ATTACHMENT), ("language", LANGUAGES)):
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df
