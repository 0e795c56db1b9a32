"""Snapshots of pages as they come: a line of JSON each, with its fields and media nested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOX = "struct<x:double,y:double,width:double,height:double>"
FIELD = f"struct<role:string,tag:string,inputType:string,name:string,id:string,label:string,placeholder:string,autocomplete:string,disabled:boolean,visible:boolean,bbox:{BOX},selectorPath:string>"
MEDIUM = f"struct<tag:string,role:string,alt:string,title:string,src:string,href:string,fileName:string,mimeType:string,ocrText:string,visible:boolean,bbox:{BOX}>"
SNAPSHOT = f"snapshot_id long, url string, title string, fields array<{FIELD}>, mediaCandidates array<{MEDIUM}>"


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The snapshots in the files of a folder. A line that can't be read is a snapshot of
    nulls; missing members are null, others are passed over."""
    return spark.read.schema(SNAPSHOT).json(path)


def snapshot_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """:func:`snapshots` as a stream, ``files`` new files a batch at most."""
    reader = spark.readStream.schema(SNAPSHOT)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(path)
