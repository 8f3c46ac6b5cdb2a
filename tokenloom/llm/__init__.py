"""Operations of a training-data pipeline over documents, vectors and chats.

Nothing outside this folder imports it. Every operator takes DataFrames and
returns DataFrames; work that must be cut from its lineage is written to the
shared folder of ``spark.checkpoint.dir`` (see ``_base.stage``), so a lost
executor costs only the tasks it ran.
"""
