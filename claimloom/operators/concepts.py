"""The built-in taxonomy: 82 concepts in three levels, as a table and as triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RDF, SKOS
from ..schemas import TRIPLES

#: Ids and labels of the published taxonomy, spelt as they are published, in its order.
CONCEPTS = """
0 Not climate misinformation or related to the climate.
1 Global warming is not happening
2 Human GHGs are not causing global warming
3 Climate impacts are not bad
4 Climate solutions won't work
5 Climate movement/science is unreliable
1_1 Ice isn't melting
1_2 Heading into ice age
1_3 Weather is cold
1_4 Hiatus in warming
1_5 Oceans are cooling
1_6 See level rise is exagerated
1_7 Extremes aren't increasing
1_8 Changed the name
2_1 It's natural cycles
2_2 Non-GHG forcings
2_3 No evidence for GHE
2_4 CO2 not rising
2_5 Emissions not raising CO2 levels
3_1 Sensitivity is low
3_2 No species impact
3_3 Not a pollutant
3_4 Only a few degrees
3_5 No link to conflict
3_6 No health impacts
4_1 Policies are harmful
4_2 Policies are ineffective
4_3 Too hard
4_4 Clean energy won't work
4_5 We need energy
5_1 Science is unreliable
5_2 Movement is unreliable
5_3 Climate is conspiracy
1_1_1 Antartica isn't melting
1_1_2 Greenland isn't melting
1_1_3 Artic isn't melting
1_1_4 Glaciers aren't vanishing
2_1_1 It's the sun
2_1_2 It's geological
2_1_3 It's the ocean
2_1_4 Past climate change
2_1_5 Tiny CO2 emissions
2_3_1 CO2 is trace gas
2_3_2 GHE is saturated
2_3_3 CO2 lags climate
2_3_4 Water vapor
2_3_5 Tropospheric hot spot
2_3_6 CO2 high in past
3_2_1 Species can adapt
3_2_2 Polar bears ok
3_2_3 Oceans are ok
3_3_1 CO2 is plant food
4_1_1 Policy increases costs
4_1_2 Policy weakens security
4_1_3 Policy harms environment
4_1_4 Rich future generations
4_1_5 Limits freedom
4_2_1 Green jobs don't work
4_2_2 Markets more efficient
4_2_3 Policy impact is negligible
4_2_4 One country is negligible
4_2_5 Better to adapt
4_2_6 China's emissions
4_2_7 Techno fix
4_3_1 Policy too difficult
4_3_2 Low public support
4_4_1 Clean energy unreliable
4_4_2 CCS is unproven
4_5_1 FF is plentiful
4_5_2 FF are cheap
4_5_3 Nuclear is good
5_1_1 No consensus
5_1_2 Proxies are unreliable
5_1_3 Temp is unreliable
5_1_4 Models are unreliable
5_2_1 Climate is religion
5_2_2 Media is alarmist
5_2_3 Politicians are biased
5_2_4 Environmentalists are alarmist
5_2_5 Scientist are biased
5_3_1 Policy is conspiracy
5_3_2 Science is conspiracy
"""


def listed() -> list[tuple[str, str, str | None]]:
    """(id, label, parent id) in the taxonomy's order."""
    rows = [line.split(" ", 1) for line in CONCEPTS.strip().split("\n")]
    return [(i, label, i.rpartition("_")[0] or None) for i, label in rows]


def place(concept_id: Column) -> Column:
    """A text that sorts concepts as the taxonomy lists them: by level, then by the numbers of the id."""
    parts = F.split(concept_id, "_")
    return F.concat(F.lpad(F.size(parts).cast("string"), 3, "0"), F.array_join(F.transform(parts, lambda x: F.lpad(x, 10, "0")), ""))


def concepts(spark: SparkSession, namespace: str) -> DataFrame:
    """(id, url, label, parent_id, ord) of the built-in taxonomy."""
    rows = spark.createDataFrame(listed(), "id string, label string, parent_id string")
    return rows.select("id", F.concat(F.lit(namespace), "id").alias("url"), "label", "parent_id", place(F.col("id")).alias("ord"))


def concept_triples(spark: SparkSession, namespace: str, scheme: str = "taxonomy") -> DataFrame:
    """The same as a SKOS graph: 413 triples with those of the scheme."""
    iri = lambda s, p, o: (namespace + s, "iri", p, o, "iri", None, None)
    text = lambda s, p, o: (namespace + s, "iri", SKOS + p, o, "literal", None, "en")
    rows = [iri(scheme, RDF + "type", SKOS + "ConceptScheme"), text(scheme, "prefLabel", "Claim taxonomy"), text(scheme, "definition", "Categories of misinformation about climate change.")]
    for i, label, parent in listed():
        rows += [iri(i, RDF + "type", SKOS + "Concept"), iri(i, SKOS + "inScheme", namespace + scheme), text(i, "prefLabel", label)]
        if parent is None:
            rows += [iri(i, SKOS + "topConceptOf", namespace + scheme), iri(scheme, SKOS + "hasTopConcept", namespace + i)]
        else:
            rows += [iri(i, SKOS + "broader", namespace + parent), iri(parent, SKOS + "narrower", namespace + i)]
    return spark.createDataFrame(rows, TRIPLES)


def skos_graph(tree: DataFrame, namespace: str, scheme: str = "taxonomy", title: str = "Claim taxonomy", definition: str | None = None, lang: str = "en") -> DataFrame:
    """The SKOS graph of any tree of (id, label, parent_id), whatever its size: one pass over its rows, and the scheme's own triples."""
    none, here = F.lit(None).cast("string"), F.lit(namespace + scheme)
    of = lambda c: F.concat(F.lit(namespace), F.col(c))

    def triple(s: Column, p: str, o: Column, literal: bool = False) -> Column:
        return F.struct(s.alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit("literal" if literal else "iri").alias("o_kind"), none.alias("o_datatype"), (F.lit(lang) if literal else none).alias("o_lang"))

    always = [triple(of("id"), RDF + "type", F.lit(SKOS + "Concept")), triple(of("id"), SKOS + "inScheme", here), triple(of("id"), SKOS + "prefLabel", F.col("label"), True)]
    top = [triple(of("id"), SKOS + "topConceptOf", here), triple(here, SKOS + "hasTopConcept", of("id"))]
    below = [triple(of("id"), SKOS + "broader", of("parent_id")), triple(of("parent_id"), SKOS + "narrower", of("id"))]
    made = tree.select(F.inline(F.concat(F.array(*always), F.when(F.col("parent_id").isNull(), F.array(*top)).otherwise(F.array(*below)))))
    own = [triple(here, RDF + "type", F.lit(SKOS + "ConceptScheme")), triple(here, SKOS + "prefLabel", F.lit(title), True)]
    if definition is not None:
        own.append(triple(here, SKOS + "definition", F.lit(definition), True))
    return made.unionByName(tree.sparkSession.range(1).select(F.inline(F.array(*own)))).where("o IS NOT NULL")
