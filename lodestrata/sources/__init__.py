"""Sources and sinks: files, pages, sheets, binary documents, links."""
