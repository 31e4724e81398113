"""Questions: intent, section detection, quality metrics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specforge import lexicon
from specforge.functions.text import bound, strip, tokenize

# Single words that are too vague to search for.
VAGUE = "hello hi hey help test ok yes no what why how who where when thanks thank".split()
# Intent patterns.
OVERVIEW = (
    r"\b(?:what\s+is\s+(?:the\s+)?(?:document|file|spec|specification)\s+(?:about|of)", r"tell\s+me\s+about\s+(?:the\s+)?(?:document|file|spec)",
    r"summar(?:y|ize|ise)\s+(?:the\s+)?(?:document|file|spec)", r"overview\s+of\s+(?:the\s+)?(?:document|file|spec)", r"describe\s+(?:the\s+)?(?:document|file|spec)",
    r"explain\s+(?:the\s+)?(?:document|file|spec)", r"what\s+(?:does|is)\s+this\s+(?:document|file|spec)", r"what\s+is\s+.*\s+about\b",
    r"what\s+\w+\s+(?:this|the)\s+(?:document|file|spec|specification)\s+(?:is\s+)?(?:about|describing|covering|for)\b", r"(?:this|the)\s+document\s+is\s+about\b",
    r"what\s+is\s+this\s+about\b", r"what\s+(?:does|do)\s+this\s+(?:document|file|spec)\s+(?:describe|cover|contain|define)\b",
    r"about\s+this\s+(?:document|file|spec|specification)\b", r"(?:this|the)\s+(?:document|file|spec)\s+(?:is\s+)?(?:about|for)\s+what\b",
    r"what\s+(?:component|system|product|part|assembly)\s+(?:is\s+)?(?:this|the)\s+(?:document|file|spec|specification)\s+(?:about|for|describing|covering)\b",
    r"which\s+(?:component|system|product)\s+(?:does\s+)?(?:this|the)\s+(?:document|file|spec|specification)\s+(?:describe|cover)\b",
    r"what\s+is\s+the\s+(?:purpose|role|function|goal|objective)\s+of\b", r"what\s+is\s+(?:this|the)\s+(?:document|file|spec|specification)\s+about\b",
    r"what\s+is\s+(?:the\s+)?(?:document|file|spec|specification)\s+(?:purpose|role|function)\b)",
)
VALIDATION = (
    r"\b(validate|check)\s+(the\s+)?(document|this\s+(document|file|spec|specification)s?)\b", r"\b(check|validate)\s+(the\s+)?(structure|template|writing\s*guide|guidelines?)\b",
    r"\brun\s+(the\s+)?validation\b", r"\bvalidate\s+(file\s+|the\s+file\s+|this\s+file\s+)?(structure|template|compliance)\b",
    r"\bcheck\s+(if\s+|whether\s+)?the\s+(document|file|spec)\s+(is\s+)?(compliant|valid|correct)\b", r"\bverify\s+(the\s+)?(document|file|spec|specification)\b",
    r"\bvalidation\s+(of|for|on)\s+(the\s+)?(document|file|spec)\b", r"\bdocument\s+(validation|check)\b", r"\bvalidate\s+\S",
)
STANDARDS = (r"\b(bestandard|be\s+standard)\b", r"\b(?:lookup|look\s+up|consult|search|find|access)\b.*\bstandards?\b", r"\bwhat\s+is\s+(?:the\s+)?iso\s*\d+\b", r"\btell\s+me\s+about\s+(?:the\s+)?(?:iso|ista|sta\d+)\b")
# Questions about a fact, about how to write a section, and looser ones that need a section's name.
FACTUAL = (
    r"\b(?:what\s+is\s+the\s+[\w\s]{0,30}?(?:voltage|current|power|temperature|frequency|speed|weight|size|price|cost|color|range|value|level|rate|target|limit|threshold|tolerance|gap|force|torque|noise|sound|pressure|load|cycle|cycles|duration|time|distance|height|width|depth|angle|material|finish|surface)\b",
    r"how\s+(?:much|many|long|far|fast|heavy|big|often)\b", r"is\s+the\s+\w+\s+(?:located|positioned|situated|placed|found|mounted)\b", r"where\s+is\b", r"when\s+(?:does|is|will)\b",
    r"who\s+(?:is|writes|checks|approves)\b", r"what\s+does\s+\w+\s+(?:mean|do|look like|contain|have)\b",
    r"what\s+are\s+the\s+(?:dimensions|measurements|tolerances|specifications|parameters|inputs|outputs)\b", r"how\s+does\s+(?:the|it|this|a)\s+\w+\s+(?:work|function|operate|behave|respond)\b",
    r"what\s+happens\s+(?:when|if|during|after|before)\b", r"what\s+is\s+(?:the\s+)?(?:price|cost|color|weight|size|meaning|definition)\b",
    r"what\s+is\s+(?:the\s+)?\w+\s+(?:signal|protocol|voltage|current|frequency|speed|power|target|limit|threshold)\b", r"how\s+(?:does|is)\s+(?:the\s+)?\w+\s+(?:signal|protocol)\s+(?:work|function|operate)\b",
    r"what\s+(?:triggers|activates|causes|drives|controls)\s+the\b", r"what\s+is\s+the\s+\w+\s+(?:used\s+for|made\s+of|composed\s+of)\b",
    r"what\s+is\s+(?:the\s+)?(?:maximum|minimum|nominal|typical|average)\s+\w+\s+\w+\b)",
)
GUIDANCE = (
    r"\b(?:what\s+(?:should|do|must|to|can)\s+(?:I|we|you)\s+(?:put|write|include|add|fill|specify|describe)\s+in\s+(?:the\s+)?",
    r"how\s+(?:to|do|should|can)\s+(?:I|we|you)\s+(?:write|fill|complete|draft|structure|handle|approach|do)\s+(?:the\s+)?", r"what\s+(?:is|are)\s+(?:the\s+)?(?:content|purpose|goal|objective)\s+of\s+(?:the\s+)?",
    r"what\s+(?:goes|belongs|should\s+go|should\s+be)\s+in\s+(?:the\s+)?", r"what\s+(?:does|do)\s+(?:the\s+)?.*?(?:section|paragraph|chapter)\s+(?:contain|include|cover|need|require)\b",
    r"guide\s+(?:me\s+)?(?:on|for|about)\s+(?:the\s+)?", r"what\s+(?:should|must|need)\s+(?:the\s+)?.*?(?:section|paragraph|chapter)\s+(?:contain|include|have)\b",
    r"help\s+(?:me\s+)?(?:with|on|about|write|fill)\s+(?:the\s+)?)",
)
LOOSE_GUIDANCE = (
    r"\b(?:what\s+(?:about|for|in)\s+(?:the\s+)?", r"tell\s+me\s+(?:about|what)\s+(?:the\s+)?", r"explain\s+(?:the\s+)?", r"how\s+(?:about|for)\s+(?:the\s+)?", r"what\s+is\s+(?:the\s+)?",
    r"comment\s+(?:rédiger|écrire|remplir|faire)\s+(?:la\s+)?(?:section|partie|chapitre)\s+", r"que\s+(?:mettre|écrire|faire|doit\s+contenir)\s+(?:dans|pour|la\s+section|le\s+)?(?:section|partie|chapitre)?\s*",
    r"que\s+doit\s+contenir\s+(?:la\s+)?(?:section\s+)?)",
    r"\b(?:how|what)\s+to\s+(?:write|put|include|fill|add|draft|create|make|do|structure)\s+(?:the\s+)?", r"\bwhat\s+(?:should|must|can|do|could)\s+(?:I|we|you|one)\s+(?:put|write|include|fill|add|draft)\s+(?:in\s+)?(?:the\s+)?",
    r"\bwhat\s+goes\s+in\s+", r"\bwhat\s+belongs\s+in\s+", r"\bwhat\s+(?:is|are)\s+(?:needed|required|expected)\s+(?:in|for)\s+(?:the\s+)?",
    r"\bhow\s+(?:should|must|can|do)\s+(?:I|we|you)\s+(?:write|fill|complete|draft|structure|approach|handle|do|prepare)\s+(?:the\s+)?",
    r"\bwhat\s+(?:must|should|shall|does)\s+(?:the\s+)?[\w\s]{2,40}?\s+(?:section|paragraph|chapter)\s+(?:contain|include|have|cover|specify|describe)\b",
    r"\bwhat\s+(?:must|should)\s+(?:the\s+)?[\w\s]{2,40}?\s+(?:contain|include)\b", r"\bque\s+(?:mettre|écrire|faire|rédiger|remplir|doit\s+contenir)\s+(?:dans|pour|la|le|les)\s+",
    r"\bcomment\s+(?:rédiger|écrire|remplir|faire|structurer)\s+(?:la|le|les|une|un)\s+",
)
# How questions of fact on one document begin; how acronyms are asked for; which file is meant.
FACTUAL_START = (
    r"^(?:combien|où|quand|où\s+est|quel\s+est|quelle\s+est|quels\s+sont|quelles\s+sont|comment|pourquoi|qui|how\s+(?:many|much|does|is|are)|where|when|which|why|what\s+(?:is|are|does|were|was))"
)
ACRONYM = r"\b(?:what\s+(?:does|is|do)\s+|what\s+is\s+the\s+meaning\s+of\s+|what\s+stands?\s+|define\s+|definition\s+of\s+)([A-Z][A-Z0-9_]{1,10})\b"
THIS_FILE = r"\b(this|the|ce|cette)\s+(document|file|spec|specification|fichier)\b"


def asks(question: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the alternatives is found, in any case."""
    return question.rlike("(?i)" + "|".join(patterns))


def shortened(question: Column) -> Column:
    return F.regexp_replace(strip(F.lower(question)), r"[?!.]+$", "")


def is_ambiguous(question: Column) -> Column:
    """Empty, a single vague word, or one telling token at most; a question for an overview never is."""
    stop = F.array(*[F.lit(w) for w in sorted(lexicon.STOP_WORDS)])
    return bound(shortened(question), lambda q: (q == "") | q.isin(*VAGUE) | (~asks(q, OVERVIEW) & (F.size(F.array_except(tokenize(q), stop)) <= 1)))


def is_brief(question: Column) -> Column:
    """The handler's own test: one word of two letters or more at most."""
    return F.size(F.regexp_extract_all(F.lower(question), F.lit("([a-zA-Zàâäéèêëîïôöùûüçñ]{2,})"), F.lit(1))) <= 1


def is_validation(question: Column) -> Column:
    return bound(strip(question), lambda q: F.lower(q).isin("validate", "validate!", "validate.", "validate?") | asks(q, VALIDATION))


def section_aliases() -> list[tuple[str, str]]:
    """(alias, section), longest first: names, aliases and French aliases; an alias of two sections belongs to the later one."""
    owner: dict[str, str] = {}
    for name, own in lexicon.SECTION_ALIASES.items():
        owner[name.lower()] = name
        owner |= dict.fromkeys((a.lower() for a in (*own, *lexicon.FRENCH_ALIASES.get(name, ()))), name)
    return sorted(owner.items(), key=lambda x: -len(x[0]))


def content_words(c: Column) -> Column:
    """Distinct words of letters that say something about a section."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-zàâäéèêëîïôöùûüçñ]+)"), F.lit(1))
    return F.array_except(words, F.array(*[F.lit(w) for w in sorted(lexicon.GUIDANCE_STOP_WORDS)]))


def worded_aliases() -> list[tuple[str, list[str]]]:
    """(section, telling words of an alias) in the order of the lists."""
    out = []
    for name, own in lexicon.SECTION_ALIASES.items():
        for alias in (*own, *lexicon.FRENCH_ALIASES.get(name, ())):
            words = set(re.findall("[a-zàâäéèêëîïôöùûüçñ]+", alias.lower())) - lexicon.GUIDANCE_STOP_WORDS
            out += [(name, sorted(words))] if words else []
    return out


def section_of(question: Column) -> Column:
    """The section of the longest alias that the question holds, else the first that shares most of an alias's words (40 % at least), or null."""

    def found(low: Column) -> Column:
        pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in section_aliases()])
        return F.get(F.filter(pairs, lambda p: F.contains(low, p["a"])), F.lit(0))["n"]

    def shared(words: Column) -> Column:
        every = F.array(*[F.struct(F.lit(n).alias("n"), F.array(*[F.lit(w) for w in own]).alias("w"), F.lit(-k).alias("k")) for k, (n, own) in enumerate(worded_aliases())])
        graded = F.transform(every, lambda a: F.struct((F.size(F.array_intersect(words, a["w"])) / F.size(a["w"])).alias("g"), a["k"].alias("k"), a["n"].alias("n")))
        return bound(F.array_max(graded), lambda b: F.when(b["g"] >= 0.4, b["n"]))

    return F.coalesce(bound(strip(F.lower(question)), found), bound(content_words(question), shared))


def is_guidance(question: Column) -> Column:
    """Asks how to write a section: its bare name, or a pattern of guidance (the looser ones only with a section)."""
    q = strip(question)
    named = F.regexp_replace(q, r"[? !.]+$", "")
    loose = asks(q, LOOSE_GUIDANCE) & section_of(q).isNotNull()
    return (F.char_length(q) >= 5) & (F.upper(named).isin(*lexicon.SECTION_ALIASES) | (~asks(q, FACTUAL) & (asks(q, GUIDANCE) | loose)))


def intent(question: Column, guidance_first: bool = False) -> Column:
    """What is done with a question: refused (standards), clarified, validated, overview, or search; the handler asks for guidance before it searches."""
    unclear = is_brief(question) if guidance_first else is_ambiguous(question)
    out = F.when(asks(question, STANDARDS), "standards").when(unclear, "clarify").when(is_validation(question), "validate")
    if guidance_first:
        out = out.when(is_guidance(question), "guidance")
    return out.when(asks(question, OVERVIEW), "overview").otherwise("search")


def question_class(question: Column) -> Column:
    """Questions on one document: factual if they begin as such and have three words, else an overview."""
    q = strip(F.lower(question))
    return F.when(q.rlike(FACTUAL_START) & (F.size(F.split(q, r"\s+")) >= 3), "factual").otherwise("overview")


def metrics(events: DataFrame, *by: str) -> DataFrame:
    """Counts and ratios of answered questions; a ratio without a denominator is null."""
    answered = ~F.col("was_not_found") & ~F.col("was_refusal")
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    d = events.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(answered).alias("answered"), F.count_if("was_not_found").alias("not_found"), F.count_if("was_refusal").alias("refusals"),
        F.count_if(answered & F.col("had_sources")).alias("sourced"), F.count_if(answered & (F.col("confidence") == "HIGH")).alias("high"),
    )
    return d.withColumns({"answer_rate": over("answered", "total"), "not_found_rate": over("not_found", "total"), "source_rate": over("sourced", "answered"), "high_rate": over("high", "answered")})


def last_events(events: DataFrame, n: int = 1000) -> DataFrame:
    """The newest n events: a top-k per partition, then one of the few that are left."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def latest_per_user(events: DataFrame, n: int = 3) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
