"""The packaged vocabularies: character roles and plot functions as typed, labelled terms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from . import vocabulary as V
from .terms import LABEL, TRIPLE, TYPE

# The terms of each vocabulary, English and Spanish labels apart by a bar.
TERMS = {
    "greimas": """
        subject | sujeto
        object | objeto
        sender | destinador
        receiver | destinatario
        helper | ayudante
        opponent | oponente
    """,
    "propp": """
        absentation | alejamiento
        interdiction | prohibición
        violation | transgresión
        reconnaissance | interrogatorio
        delivery | información
        trickery | engaño
        complicity | complicidad
        villainy, lack | fechoría, carencia
        mediation | mediación
        counteraction | principio de la acción contraria
        departure | partida
        donor function | primera función del donante
        hero reaction | reacción del héroe
        acquisition | recepción del objeto mágico
        guidance | desplazamiento
        struggle | combate
        branding | marca
        victory | victoria
        liquidation | reparación
        return | regreso
        pursuit | persecución
        rescue | socorro
        unrecognized arrival | llegada de incógnito
        unfounded claims | pretensiones engañosas
        difficult task | tarea difícil
        solution | realización de la tarea
        recognition | reconocimiento
        exposure | desenmascaramiento
        transfiguration | transfiguración
        punishment | castigo
        wedding | boda
    """,
}


def terms(name: str) -> list[tuple[str, str, str, str, None, str | None]]:
    """The triples of a vocabulary: a type and its labels for each term."""
    rows: list = []
    for line in TERMS[name].strip().splitlines():
        english, spanish = ([w.strip() for w in side.split(",")] for side in line.split("|"))
        term = f"{V.BW}{name}/{english[0].replace(' ', '-')}"
        rows.append((term, TYPE, V.CLASS["type"], "iri", None, None))
        rows += [(term, LABEL, w, "lit", None, lang) for lang, words in (("en", english), ("es", spanish)) for w in words]
    return rows


def packaged(spark: SparkSession, active: Iterable[str]) -> dict[str, DataFrame]:
    """The graphs of the active vocabularies; names that are not packaged are ignored."""
    return {name: spark.createDataFrame(terms(name), TRIPLE) for name in active if name in TERMS}
