"""SQL over HTTP, in the wire protocol of Presto clients."""
