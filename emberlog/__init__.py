"""Log forensics on Spark: lines to entries to clusters to verdicts, as DataFrame plans."""
