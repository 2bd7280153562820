"""Where rows come from: pages, RDF files, remote SPARQL, stored documents."""
