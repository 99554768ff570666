"""quillweave: conversation-log analytics and retrieval on PySpark DataFrames."""
