"""Event semantics: modal classes, suppression of secondary classes, the noun predicate table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import vocab

CONFIDENT = 80


def modal_class(modal: Column, future: Column) -> Column:
    """Class of a modal verb; can and could change theirs with the future tense; null for others."""
    key = F.when(modal.isin("can", "could") & F.coalesce(future, F.lit(False)), F.concat(modal, F.lit("-future"))).otherwise(modal)
    table = F.create_map(*[F.lit(x) for kv in vocab.MODAL_CLASS.items() for x in kv])
    return F.try_element_at(table, key)


def concept_class(description: Column) -> Column:
    """Class of a group of people by the first keyword that its description has; null for none."""
    out, low = F, F.lower(description)
    for word, name in vocab.CONCEPT_CLASS.items():
        out = out.when(F.contains(low, F.lit(word)), name)
    return out


def category(ordinal: Column, values: list[str], default: str) -> Column:
    """Class of a 1-based ordinal; the default outside of the vocabulary."""
    return F.when(ordinal.between(1, len(values)), F.element_at(F.array(*[F.lit(v) for v in values]), F.greatest(F.least(ordinal, F.lit(len(values))), F.lit(1)).cast("int"))).otherwise(default)


def kept_classes(classes: Column) -> Column:
    """Ordered array of (class, confidence) without suppressed secondary classes.

    Only confident classes count as earlier ones. After the first entry these go: avoidance, the general
    class, affiliation after an attribute, assessment after a speech act."""
    empty = F.filter(classes, lambda x: F.lit(False))

    def confident(state: Column, name: str) -> Column:
        return F.exists(state["kept"], lambda k: (k["class"] == name) & (k["confidence"] > CONFIDENT))

    def step(state: Column, x: Column) -> Column:
        later = state["seen"] > 0
        c = x["class"]
        drop = later & (
            c.isin(":Avoidance", ":EventAndState")
            | ((c == ":Affiliation") & confident(state, ":AttributeAndCharacteristic"))
            | ((c == ":AssessmentMeasurement") & confident(state, ":CommunicationAndSpeechAct"))
        )
        return F.struct((state["seen"] + 1).alias("seen"), F.when(drop, state["kept"]).otherwise(F.concat(state["kept"], F.array(x))).alias("kept"))

    return F.aggregate(classes, F.struct(F.lit(0).alias("seen"), empty.alias("kept")), step, lambda s: s["kept"])


def _has(classes: Column, *names: str) -> Column:
    """Any class string that contains one of the names."""
    return F.exists(classes, lambda c: F.lit(False) if not names else _any([c.contains(n) for n in names]))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def predicate(role: Column, event: Column, noun: Column, text: Column, any_agent: Column) -> Column:
    """Predicate from an event to a noun: the first rule that holds, null for unknown roles.

    event: array of the event's confident classes; noun: the noun's class string; any_agent: whether
    some noun of the same event is its agent, see with_any_agent()."""
    role = F.lower(role)
    agent, place = noun.isin(vocab.AGENT_CLASSES), noun.isin(vocab.LOCATION_BUSINESS)
    animate = noun.isin([c for c in vocab.AGENT_CLASSES if ":Plant" not in c])
    measure = _has(event, ":Measurement", ":AssessmentMeasurement") | _any([noun.contains(x) for x in (":Measurement", ":AssessmentMeasurement")])
    attribute = _has(event, ":AttributeAndCharacteristic")
    group = _any([noun.contains(x) for x in (":LineOfBusiness", ":EthnicGroup", ":PoliticalGroup", ":ReligiousGroup")])
    feeling = _has(event, ":EmotionalResponse", ":SensoryPerception", ":AttributeAndCharacteristic", ":Cognition")
    table = F.create_map(*[F.lit(x) for r in vocab.ROLES for x in (r, vocab.ROLE_PREDICATE[r])])
    return (
        F.when(measure, F.when(text.rlike(r"\p{Nd}"), ":has_quantification").otherwise(":has_context"))
        .when(attribute & group, ":has_aspect")
        .when(attribute & role.isin("agent", "experiencer"), ":has_context")
        .when(_has(event, ":Affiliation"), F.when(role.isin("agent", "experiencer", "subject"), ":has_context").otherwise(":affiliated_with"))
        .when(noun == ":Affiliation", ":has_context")
        .when(_has(event, ":MovementTravelAndTransportation") & (role == "theme") & place, ":has_destination")
        .when(feeling & (role == "experiencer"), ":has_active_entity")
        .when((role == "location") & ~place, ":has_context")
        .when((role == "source") & agent, ":has_source")
        .when((role == "recipient") & place, ":has_destination")
        .when((role == "patient") & place, ":has_location")
        .when((role == "experiencer") & ~animate, ":has_context")
        .when((role == "experiencer") & ~any_agent, ":has_active_entity")
        .when((role == "goal") & animate, ":has_affected_entity")
        .when((role == "goal") & ~place, ":has_context")
        .otherwise(F.try_element_at(table, role))
    )


def with_any_agent(args: DataFrame, event: str = "event", role: str = "role") -> DataFrame:
    return args.withColumn("any_agent", F.max(F.col(role) == "agent").over(Window.partitionBy(event)))


def chained(events: DataFrame, owner: str = "situation", node: str = "event", seq: str = "seq") -> DataFrame:
    """has_first and has_next of ordered events: is_first, next."""
    order = Window.partitionBy(owner).orderBy(seq)
    return events.withColumn("is_first", F.row_number().over(order) == 1).withColumn("next", F.lead(node).over(order))


def details_concatenated(texts: Column, width: int = 90) -> Column:
    """Texts joined by '; ', each cut to the width; one that is part of what came before is left out."""
    from loomgraph.functions.text import truncated

    def step(out: Column, x: Column) -> Column:
        return F.when(F.contains(out, x), out).when(out == "", truncated(x, width)).otherwise(F.concat(out, F.lit("; "), truncated(x, width)))

    return F.aggregate(texts, F.lit(""), step)


def whitelisted(entities: Column) -> Column:
    """Entities (text, ner_type) of the types that have a class; times are not among them."""
    return F.filter(entities, lambda e: e["ner_type"].isin(list(vocab.NER_CLASS)))
