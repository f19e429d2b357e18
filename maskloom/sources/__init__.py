"""Sources and sinks: utterance loading, fixture views, snapshots and ledgers."""
