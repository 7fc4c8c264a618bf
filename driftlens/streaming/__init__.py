"""Incremental runs over folders of artefacts. An extension: the study itself is a batch."""
