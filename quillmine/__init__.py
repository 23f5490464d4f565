"""quillmine: code-intelligence, memory and corpus analytics on Spark DataFrames."""
