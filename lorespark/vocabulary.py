"""Class and predicate IRIs, prefixes and scales of the story graph."""

from __future__ import annotations

from .terms import RDF, RDFS, XSD

GOLEM = "https://w3id.org/golem/ontology#"
CRM = "http://www.cidoc-crm.org/cidoc-crm/"
DLP = "http://www.ontologydesignpatterns.org/ont/dlp/DOLCE-Lite.owl#"
EDNS = "http://www.ontologydesignpatterns.org/ont/dlp/ExtendedDnS.owl#"
TR = "http://www.ontologydesignpatterns.org/ont/dlp/TemporalRelations.owl#"
CSM = "http://www.ontologydesignpatterns.org/ont/dlp/CommonSenseMapping.owl#"
#: The project's own terms. Set it before use where graphs with another namespace are read.
BW = "https://example.org/vocab/bw#"

PREFIXES = {"golem": GOLEM, "crm": CRM, "dlp": DLP, "edns": EDNS, "tr": TR, "csm": CSM, "bw": BW, "rdf": RDF, "rdfs": RDFS, "xsd": XSD}

CLASS = {
    "character": GOLEM + "G1_Character",
    "object": GOLEM + "G16_Object",
    "relationship": GOLEM + "G4_Social_Relationship",
    "relationship-role": GOLEM + "G6_Relationship_Role",
    "event": GOLEM + "G5_Narrative_Event",
    "state": GOLEM + "G3_Psychological_State",
    "setting": GOLEM + "G12_Setting",
    "location": GOLEM + "G13_Narrative_Location",
    "narrative-unit": GOLEM + "G9_Narrative_Unit",
    "narrative-function": GOLEM + "G10_Narrative_Function",
    "role": GOLEM + "G11_Narrative_Role",
    "narrative-sequence": GOLEM + "G7_Narrative_Sequence",
    "assertion": CRM + "E13_Attribute_Assignment",
    "feature": GOLEM + "G17_Character_Feature",
    "dimension": CRM + "E54_Dimension",
    "type": CRM + "E55_Type",
    "interval": DLP + "time-interval",
    "time-span": CRM + "E52_Time-Span",
}
PARTICIPANT = DLP + "participant"
PROPER_PART = DLP + "proper-part"
DEPENDENT_ON = DLP + "generically-dependent-on"
GENERIC_LOCATION = DLP + "generic-location"
REFERS_TO = CRM + "P67_refers_to"
ASSIGNED_TO = CRM + "P140_assigned_attribute_to"
ASSIGNED = CRM + "P141_assigned"
USED_OBJECT = CRM + "P16_used_specific_object"
HAS_FEATURE = GOLEM + "GP0_has_feature"
PLAYS = EDNS + "plays"
HAS_TYPE = CRM + "P2_has_type"
HAS_DIMENSION = CRM + "P43_has_dimension"
HAS_VALUE = CRM + "P90_has_value"
DURATION = CSM + "duration"
TEMPORAL_LOCATION = TR + "temporal-location"
RELATIONS = {
    "follows": TR + "follows",
    "precedes": TR + "precedes",
    "overlaps": TR + "temporally-overlaps",
    "includes": TR + "temporally-includes",
    "included_in": TR + "temporally-included-in",
}
HAS_TIME_SPAN = CRM + "P4_has_time-span"
BEGIN = CRM + "P82a_begin_of_the_begin"
END = CRM + "P82b_end_of_the_end"
CLAIM, ASSERTED_BY, SUPPORTED_BY, OPEN = BW + "claim", BW + "assertedBy", BW + "supportedBy", BW + "open"
PROMOTES, CONSTRAINS, ORDINAL = BW + "promotes", BW + "constrains", BW + "sequenceOrdinal"
SOURCE_TYPES = {
    "primaria": "primaria",
    "secundaria": "secundaria",
    "oficial": "oficial",
    "académica": "academica",
    "periodística": "periodistica",
    "testimonial": "testimonial",
}
RELIABILITY = ("baja", "media", "alta")  # from the lowest
#: Label, predicate of a source's mandatory facets; the last one only for a foreign source.
FACETS = (
    ("type", HAS_TYPE),
    ("reliability", BW + "reliability"),
    ("reliability justification", BW + "reliabilityJustification"),
    ("reference", BW + "reference"),
    ("author", BW + "author"),
    ("original language", BW + "originalLanguage"),
    ("access date", BW + "accessDate"),
    ("original quote", BW + "originalQuote"),
    ("translation", BW + "translation"),
)
SEVERITY = {"info": 0, "warning": 1, "error": 2}
