def made(): pass
