"""What is written: texts, books, reports and manifests."""
