"""Sources and sinks: pages, HTTP search, files, tables of batches."""
