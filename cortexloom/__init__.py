"""cortexloom: barcode-sequencing projection mapping as Spark DataFrame jobs."""
