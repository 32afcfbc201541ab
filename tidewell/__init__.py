"""tidewell: product-listing, price-history and corpus analytics as Spark plans."""
