"""Controlled vocabularies. Ordinals are 1-based positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The vocabularies of the annotation model, in their order.
EVENT_CATEGORIES = [
    ":AchievementAndAccomplishment", ":AcquisitionPossessionAndTransfer", ":Affiliation", ":Agreement",
    ":AgricultureApicultureAndAquacultureEvent", ":AidAndAssistance", ":AppointmentAndNomination",
    ":ArtAndEntertainmentEvent", ":AssessmentMeasurement", ":Attempt", ":AttributeAndCharacteristic",
    ":Avoidance", ":Birth", ":BodilyAct", ":Causation", ":Cognition", ":Commemoration",
    ":CommunicationAndSpeechAct", ":Continuation", ":CorruptionAndFraud", ":CourtOrderAndRuling",
    ":CrimeAndHostileConflict", ":DamageAndDifficulty", ":Death", ":DeceptionAndDishonesty", ":Decrease",
    ":DelayAndWait", ":DemonstrationStrikeAndRally", ":Diplomacy", ":DisagreementAndDispute",
    ":DiscriminationAndPrejudice", ":DistributionSupplyAndStorage", ":DivorceAndSeparation",
    ":EconomyAndFinanceRelated", ":EducationRelated", ":EmotionalResponse", ":End", ":EnvironmentalIssue",
    ":HealthAndDiseaseRelated", ":ImpactAndContact", ":InclusionAttachmentAndUnification", ":Increase",
    ":InternationalRelations", ":IssuingAndPublishing", ":LawEnforcement", ":LawRelated", ":LivingCondition",
    ":Marriage", ":Measurement", ":MeetingAndEncounter", ":Mistake", ":MovementTravelAndTransportation",
    ":OpenMindednessAndTolerance", ":PhysicalChange", ":PoliticsRelated", ":Polling",
    ":ProductionManufactureAndCreation", ":Punishment", ":ReadinessAndAbility", ":ReligionRelated",
    ":Relocation", ":RemovalAndRestriction", ":Residence", ":ReturnRecoveryAndRelease",
    ":RewardAndCompensation", ":RiskTaking", ":Scandal", ":ScienceAndTechnologyRelated", ":Search",
    ":SensoryPerception", ":Separation", ":SpaceEvent", ":StartAndBeginning", ":Substitution", ":Terrorism",
    ":UtilizationAndConsumption", ":Win", ":Loss", ":EventAndState",
]
NOUN_CATEGORIES = [
    ":Animal", ":ArmedForce", ":Prison", ":BuildingAndDwelling", ":OrganizationalEntity", ":Ceremony",
    ":ComponentPart", ":Currency", ":DamageAndDifficulty", ":DiagnosticTest", ":DiseaseAndInfection",
    ":EthnicGroup", ":ExecutiveAndLegislativeGroup", ":FreedomAndSupportForHumanRights",
    ":GeopoliticalEntity", ":GovernmentalEntity", ":InformationSource", ":JudicialGroup", ":LawAndPolicy",
    ":LegalInstrument", ":LineOfBusiness", ":Location", ":MachineAndTool", ":MedicalTest",
    ":MusicalInstrument", ":OrganizationalEntity", ":ParamilitaryAndRebelGroup", ":Person",
    ":Person, :Collection", ":PharmaceuticalAndMedicinal", ":Plant", ":PoliceForce", ":PoliticalGroup",
    ":Process", ":Product", ":ReligiousGroup", ":SubstanceAndRawMaterial", ":Symptom",
    ":TherapyAndMedicalCare", ":Vaccine", ":Vehicle", ":WeaponAndAmmunition", ":War", ":WasteAndResidue",
    ":Resource", "owl:Thing",
]
SUBJECTS = ["crime and law", "economy and business", "education", "entertainment", "environment and ecology", "health", "human interest", "lifestyle", "politics and international", "science and technology", "sports"]
GOALS = ["advocate", "analyze", "describe-set", "describe-single", "entertain", "establish-authority", "inspire", "investigate", "relate-life-story"]
FLOWS = ["narrative/episodic", "chronological", "comparative", "thematic/multifaceted", "analytical", "argumentative", "causal", "fragmented", "speculative/forward-looking", "historical context", "cyclical", "spiral", "summarized", "inverted pyramid", "question-answer"]
PLOTLINES = ["conflict and resolution", "rise and fall", "overcoming the monster/heroic acts", "rags to riches", "scandal and accountability", "quest", "personal transformation", "justice and revenge"]
ACTORS = ["hero", "mentor", "villain", "innocent", "lover", "victim", "rebel", "caregiver", "everyman", "outcast", "supporter", "trickster", "creator", "ruler"]
DEVICES = ["ad baculum", "ad hominem", "ad populum", "allusion", "exceptionalism", "expletive", "imagery", "invective", "loaded language", "logos", "paralipsis", "pathos", "rhetorical question or accusation"]
MODALS = ["can", "could", "have to", "may", "might", "must", "ought to", "shall", "should", "would"]
# Class of a modal verb; '-future' is added to can and could in the future tense.
MODAL_CLASS = {
    "can": ":ReadinessAndAbility",
    "can-future": ":OpportunityAndPossibility",
    "could": ":ReadinessAndAbility",
    "could-future": ":OpportunityAndPossibility",
    "have to": ":RequirementAndDependence",
    "may": ":OpportunityAndPossibility",
    "might": ":OpportunityAndPossibility",
    "must": ":RequirementAndDependence",
    "ought to": ":AdviceAndRecommendation",
    "shall": ":RequirementAndDependence",
    "should": ":AdviceAndRecommendation",
    "would": ":OpportunityAndPossibility",
}
# Predicate of a semantic role.
ROLE_PREDICATE = {
    "affiliation": ":affiliated_with", "agent": ":has_active_entity", "attribute": ":has_aspect",
    "beneficiary": ":has_affected_entity", "cause": ":has_cause", "content": ":has_topic",
    "co-agent": ":has_active_entity", "co-patient": ":has_affected_entity", "experiencer": ":has_affected_entity",
    "goal": ":has_destination", "instrument": ":has_instrument", "location": ":has_location",
    "measure": ":has_quantification", "patient": ":has_affected_entity", "purpose": ":has_goal",
    "recipient": ":has_recipient", "source": ":has_origin", "state": ":has_aspect", "subject": ":has_context",
    "theme": ":has_topic", "time": ":has_time",
}
# The roles that annotations may use; beneficiary, co-agent and co-patient are not among them.
ROLES = [
    "affiliation", "agent", "patient", "content", "theme", "experiencer", "instrument", "cause", "location", "time",
    "goal", "source", "state", "subject", "purpose", "recipient", "measure", "attribute",
]
# Class of an entity type; types of background names.
NER_CLASS = {
    "PERSON": ":Person", "NORP": ":GroupOfAgents", "ORG": ":OrganizationalEntity", "GPE": ":GeopoliticalEntity",
    "LOC": ":Location", "FAC": ":Location, :AnthropogenicFeature", "EVENT": ":EventAndState",
    "DATE": ":PointInTime", "LAW": ":LawAndPolicy", "PRODUCT": ":Resource", "WORK_OF_ART": ":ArtAndCollectible",
}
BACKGROUND_NER = {"law": "LAW", "organization": "ORG", "person": "PERSON", "place": "LOC", "thing": "PRODUCT", "norp": "NORP"}
# Class strings that count as agents and as places, compared as a whole.
AGENT_CLASSES = [
    ":Person", ":Person, :Collection",
    ":GovernmentalEntity", ":GovernmentalEntity, :Collection",
    ":GeopoliticalEntity", ":GeopoliticalEntity, :Collection",
    ":OrganizationalEntity", ":OrganizationalEntity, :Collection",
    ":EthnicGroup", ":EthnicGroup, :Collection",
    ":PoliticalGroup", ":PoliticalGroup, :Collection",
    ":ReligiousGroup", ":ReligiousGroup, :Collection",
    ":Animal", ":Animal, :Collection",
    ":Plant", ":Plant, :Collection",
]
LOCATION_BUSINESS = [
    ":BuildingAndDwelling", ":BuildingAndDwelling, :Collection",
    ":Location", ":Location, :Collection",
    ":GeopoliticalEntity", ":GeopoliticalEntity, :Collection",
    ":LineOfBusiness", ":LineOfBusiness, :Collection",
]
# people's titles, relatives, pronouns, prepositions and clause marks.
HONORIFICS = ["Mr. ", "Mrs. ", "Ms. ", "Doctor ", "Dr. ", "Messrs. ", "Miss ", "Mx. ", "Sir ", "Dame ", "Lady ", "Esq. ", "Professor ", "Fr. ", "Sr. ", "Rep. "]
FEMALE_TITLES, MALE_TITLES = ["Miss", "Ms", "Mrs"], ["Mr"]
FAMILY = {
    "mother": "FEMALE", "father": "MALE", "sister": "FEMALE", "brother": "MALE", "aunt": "FEMALE", "uncle": "MALE",
    "grandmother": "FEMALE", "grandfather": "MALE", "grandparent": "", "parent": "", "sibling": "", "cousin": "", "relative": "",
}
PERSONAL_PRONOUNS = ["I", "we", "us", "they", "them", "he", "she", "it", "myself", "ourselves", "themselves", "herself", "himself", "itself"]
PLURAL_PRONOUNS = ["we", "us", "they", "them", "ourselves", "themselves"]
POSSESSIVE_PRONOUNS = ["my", "our", "his", "her", "their", "its"]
INDEFINITE_PRONOUNS = {"all": "plural", "both": "plural", "few": "plural", "many": "plural", "most": "plural", "none": "zero", "some": "plural"}
PREPOSITIONS = ["about", "after", "along", "at", "before", "during", "in", "inside", "into", "for", "from", "near", "of", "on", "out", "outside", "to", "with"]
RELATIVE_WORDS = ["who", "whose", "whom", "which", "that", "where", "when", "why"]
CONJUNCTIONS = ["and", "nor", "but", "or", "yet"]
CLAUSE_MARKS = {
    "reason": ["as", "because", "due to", "for", "given", "given that", "since", "so"],
    "possibility": ["if", "in case", "lest", "provided that", "unless"],
    "purpose": ["in order that", "in order to", "so that"],
}
# Keywords of a description and the class that they stand for, in the order in which they are tried.
CONCEPT_CLASS = {"politic": ":PoliticalIdeology", "ideolog": ":PoliticalIdeology", "religio": ":ReligiousBelief", "ethnic": ":Ethnicity", "ethno": ":Ethnicity", "nationality": ":Ethnicity"}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
ARTICLES = ["a", "A", "an", "An", "the", "The"]
# Parts of addresses that are not read.
EXCLUDED_URL_PARTS = ["/video", "/live", "/tv", "bbc.co.uk/programmes"]
# Sites by a part of their address, in the order in which they are tried: where the article starts
# (tag, or tag&attribute&value; schemaorg: in the page's JSON-LD) and which elements hold its text. No rule: not read.
SITE_RULES = {
    "abcnews.go.": ["article", "p"],
    ".afr.": ["article", "p"],
    ".aljazeera.": ["div&class&wysiwyg--all-content", "p"],
    "apnews.com": ["div&class&RichTextStoryBody", "p"],
    ".bbc.": ["", "p&class&ssrcss-1q0x1qg-Paragraph"],
    ".bloomberg.": [],
    ".breitbart.": ["div&class&entry-content", "p", "p&class&rmoreabt"],
    ".businessinsider.": ["schemaorg", "articleBody"],
    ".cbc.ca": ["div&class&story", "p"],
    ".cbsnews.": ["schemaorg", "articleBody"],
    ".ctvnews.": ["div&class&c-text", "p"],
    ".cnn.": ["schemaorg", "articleBody"],
    "economictimes.indiatimes.": ["", "article"],
    ".foxnews.": ["schemaorg", "articleBody"],
    ".france24.": [],
    ".ft.": [],
    "globalnews.ca": ["article", "p"],
    ".hindustantimes.": [],
    ".independent.": ["div&class&sc-cvxyxr-6", "p"],
    ".indiatoday.": ["main&class&main__content", "p"],
    "irishtimes.": ["article&class&article-body-wrapper", "p"],
    ".jpost.": ["schemaorg", "articleBody"],
    ".moneycontrol.": ["schemaorg", "articleBody"],
    ".nbcnews.": ["schemaorg", "articleBody"],
    ".ndtv.": ["div&itemprop&articleBody", "p"],
    ".newsweek.": ["schemaorg", "articleBody"],
    "nypost.": ["", "p"],
    ".nytimes.": ["", "p&class&css-at9mc1"],
    ".politico.": ["", "p&class&story-text__paragraph"],
    ".reuters.": ["", "p&data-testid&*paragraph-"],
    ".rt.": ["div&class&article__text", "p", "div&class&article__share article__share_bottom"],
    ".thedailybeast.": ["article&class&Body hpCCr", "p", "p&class"],
    ".theglobeandmail.": ["", "p&class&c-article-body__text"],
    ".theguardian.": ["div&class&article-body-commercial-selector", "p&class&dcr-94xsh"],
    "thehill.": ["article", "p"],
    "timesofindia.indiatimes": ["schemaorg", "articleBody"],
    ".usatoday.": ["article", "p"],
    ".vnexpress.": ["div&class&fck_detail", "p"],
    ".washingtonpost.": ["schemaorg", 'hasPart/cssSelector=".article-body"/value'],
    ".washingtontimes.": ["div&class&storyareawrapper", "p"],
    ".wsj.": [],
}
# Items of a public knowledge base whose instances a description may be of, by entity type.
ALLOWED_ITEMS = {
    "PERSON": ["Q5", "Q214339", "Q4164871", "Q12737077", "Q28640"],
    "NORP": ["Q231002", "Q41710", "Q7210356", "Q12909644", "Q111252415", "Q13414953"],
    "ORG": ["Q43229", "Q106668099", "Q131085629"],
    "GPE": ["Q16562419", "Q1063239", "Q3455524"],
    "LOC": ["Q17334923", "Q123349660"],
    "FAC": ["Q27096235"],
    "EVENT": ["Q1190554", "Q3505845", "Q483247"],
    "DATE": ["Q26907166"],
    "LAW": ["Q7748", "Q1151067", "Q1156854"],
    "PRODUCT": ["Q2424752"],
    "WORK_OF_ART": ["Q838948", "Q2342494"],
}
SOURCE_BIAS = {
    "analysis": {"center": ["Economist", "Wall Street Journal"], "conservative": ["Breitbart", "Fox News", "Washington Times"]},
    "query": {"center": ["Christian Science Monitor", "Wall Street Journal"], "conservative": ["Breitbart", "Fox News", "Washington Times"]},
}


def numbered(spark: SparkSession, values: list[str]) -> DataFrame:
    """(ordinal, label) of a vocabulary."""
    return spark.createDataFrame(list(enumerate(values, 1)), "ordinal int, label string")


def category_prompt(values: list[str]) -> str:
    """'1. first 2. second ...' as given to an annotator."""
    return " ".join(f"{k}. {v}" for k, v in enumerate(values, 1))
