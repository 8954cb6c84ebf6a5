"""Classification of raw relation labels into a fixed taxonomy by conservative rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relation, the whole labels that mean it, confidence; the first rule that fits counts.
RULES = [
    ("abbreviation_expansion", "stands for|expansion|full form|abbreviation for|acronym for", 0.99),
    ("description_named_term", "term for definition|term for|scientific term|technical term|word for|name for definition", 0.99),
    ("term_definition", "definition|meaning|means|defined as|refers to|definition of|meaning of", 0.98),
    ("entity_alias", "synonym|common name|also called|also known as|commonly called|nickname|nickname for|alternative name|another name", 0.98),
    ("entity_antonym", "opposite|antonym|opposite of", 0.99),
    ("entity_classification", "type|type of|types|types of|kind of|is a|is a type of|form of|category|taxonomic classification", 0.92),
    ("organism_habitat", "habitat|native to|native range|lives in|natural habitat|native hemisphere", 0.97),
    ("entity_location", "located in|location|found in|occurs in|country|located in the state|place of occurrence|geographic location", 0.95),
    ("entity_origin", "origin|place of origin|etymological origin|country of origin|source region|originated in|derived from", 0.94),
    ("part_of", "part of|part of system|part of cycle|body system|member of|belongs to system|contained in", 0.96),
    ("has_part", "contains|contain|include|includes|has component|components|typical contents|constituent|constituents", 0.94),
    ("made_of", "made of|mainly composed of|composition|material|consists of|constituent material", 0.96),
    ("entity_function", "purpose|function|main function|primary function|shared function|role|used for|serves to|primary activity", 0.96),
    ("activity_goal", "goal|objective|aim|intended outcome", 0.96),
    ("activity_requirement", "requires|required for|needs|necessary for|depends on|prerequisite", 0.95),
    ("effect_cause", "caused by|cause of|formed by|produced by|results from|source of", 0.96),
    ("cause_effect", "causes|cause|can cause|results in|leads to|can lead to|effect of|affects|produces effect", 0.96),
    ("producer_product", "produces|product|output|yields|creates|forms|sound produced", 0.92),
    ("entity_formation_agent", "formation agent|deposition agent|formed by|created by process", 0.94),
    ("quantity_unit", "unit of measurement|si unit|unit|measured in", 0.98),
    ("measurement_target", "measures|measure|measurement target", 0.95),
    ("entity_measurement", "measurement|amount|number|percentage|rate|height|length|width|mass|weight|temperature|freezing point|distance|number of legs", 0.93),
    ("entity_time", "date|year|time|duration|period|start time|end time|founded in|born in|died in|occurs after|age", 0.94),
    ("work_creator", "author|creator|developer|inventor|discoverer|quotation author|written by|created by|developed by|invented by|founded by", 0.97),
    ("description_example", "example|example of|instance|instance of", 0.90),
    ("symbol_meaning", "represents|symbolizes|symbol for|indicates|indicate", 0.90),
    ("entity_controller", "controlled by|regulated by|governed by|determined by|controlled through", 0.95),
    ("entity_protection", "protected by|protective covering|covering|protection", 0.96),
    ("entity_transformation", "becomes|evolved into|transforms into|converted into|changes into|energy transformation|converts .+ into", 0.94),
    ("sequence_successor", "comes after|followed by|next stage|successor", 0.93),
    ("entity_capability", "can|can perform|capable of|behavior|action|typical action", 0.88),
    ("entity_attribute", "attribute|property|characteristic|feature|color|shape|status|electrical charge|state|description", 0.90),
    ("description_named_entity", "name|identity|is the|called", 0.86),
]
AMBIGUOUS = "is|are|has|source|form|mechanism|effect|relation|associated with|related to|considered to be"
CLASS_LIKE = "class|category|type|rank|group|kingdom|phylum|family|order|genus|species"
CLASS_CONFIDENCE = 0.90


def classified(label: Column, answer_type: Column) -> Column:
    """Struct (status, relation, confidence): mapped, ambiguous (broad labels and single words) or
    out_of_taxonomy; ``classification`` is mapped only where the answer's type names a class."""
    raw = F.lower(F.trim(label))

    def made(status: str, relation: str | None = None, confidence: float | None = None) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(relation).cast("string").alias("relation"), F.lit(confidence).cast("double").alias("confidence"))

    special = raw == "classification"
    out = F.when(special & F.lower(answer_type).rlike(CLASS_LIKE), made("mapped", "entity_classification", CLASS_CONFIDENCE)).when(special, made("ambiguous"))
    for relation, labels, confidence in RULES:
        out = out.when(raw.rlike(f"^({labels})$"), made("mapped", relation, confidence))
    return out.when(raw.rlike(f"^({AMBIGUOUS})$") | (F.regexp_count(raw, F.lit(r"\S+")) <= 1), made("ambiguous")).otherwise(made("out_of_taxonomy"))
