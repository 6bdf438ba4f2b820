"""A small university: seven relations for trying out joins and groups."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from .ddl import Schema, parse_schema

DDL = """
create table professoren (persnr integer not null, name varchar(20) not null, rang varchar(2) not null, raum integer not null, primary key (persnr));
create table studenten (matrnr integer not null, name varchar(20) not null, semester integer not null, primary key (matrnr));
create table vorlesungen (vorlnr integer not null, titel varchar(40) not null, sws integer not null, gelesenvon integer not null, primary key (vorlnr));
create table voraussetzen (vorgaenger integer not null, nachfolger integer not null);
create table hoeren (matrnr integer not null, vorlnr integer not null);
create table assistenten (persnr integer not null, name varchar(20) not null, fachgebiet varchar(40) not null, boss integer not null, primary key (persnr));
create table pruefen (matrnr integer not null, vorlnr integer not null, persnr integer not null, note numeric(2,1) not null);
"""

ROWS = {
    "professoren": [(1, "Ada", "C4", 10), (2, "Blaise", "C3", 11), (3, "Carl", "C4", 12)],
    "studenten": [(100, "Dora", 2), (101, "Emil", 2), (102, "Fritz", 6), (103, "Gerda", 8), (104, "Hans", 8), (105, "Ida", 12)],
    "vorlesungen": [(500, "Logik", 4, 1), (501, "Datenbanken", 4, 2), (502, "Statistik", 2, 3), (503, "Seminar", 2, 1)],
    "voraussetzen": [(500, 501), (500, 503), (502, 503)],
    "hoeren": [(100, 500), (101, 500), (101, 501), (102, 502), (103, 501), (103, 503), (105, 503)],
    "assistenten": [(20, "Jan", "Beweise", 1), (21, "Karla", "Anfragen", 2)],
    "pruefen": [(102, 502, 3, Decimal("1.7")), (103, 501, 2, Decimal("2.0")), (105, 503, 1, Decimal("1.0"))],
}


def declared() -> Schema:
    return parse_schema(DDL)


def load_university(spark: SparkSession) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame(ROWS[n], r.spark()) for n, r in declared().relations.items()}
